"""A small table kept as a log of versions.

A change writes only the rows it changes, as Parquet, and then names them in one commit file whose number is the next version.
The file appears whole or not at all, and never twice under one number, so a reader sees whole versions only, a writer that
dies leaves the table as it was, and of two writers that start from the same version the second is told so. Every
``COMPACT`` versions the commit names a full copy, so that a reader opens few folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT = 20
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has made this version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema)

    # files

    def _hadoop(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._hadoop().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[tuple[int, str, str]]:
        """``(version, kind, folder)`` in order."""
        folder = self._hadoop("commits")
        files = self._files()
        if not files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().isdigit())
        read = self.spark._jvm.org.apache.commons.io.IOUtils.toString
        out = []
        for name in names:
            stream = files.open(self._hadoop("commits", name))
            try:
                kind, data = read(stream, "UTF-8").split()
            finally:
                stream.close()
            out.append((int(name), kind, data))
        return out

    def _publish(self, version: int, kind: str, data: str) -> None:
        files, jvm = self._files(), self.spark._jvm
        beside, final = self._hadoop("commits", f"_{data}"), self._hadoop("commits", f"{version:012d}")
        stream = files.create(beside, True)
        stream.write(bytearray(f"{kind} {data}", "utf-8"))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: never replace
        try:
            context.rename(beside, final, options)
        except Py4JJavaError as error:
            files.delete(beside, False)
            if files.exists(final):
                raise Conflict(f"version {version} of {self.path} exists") from error
            raise

    # versions

    def version(self) -> int:
        """The newest version; 0 before the first change."""
        return max((version for version, _, _ in self._commits()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        commits = [c for c in self._commits() if version is None or c[0] <= version]
        first = max((i for i, c in enumerate(commits) if c[1] == "full"), default=0)
        commits = commits[first:]
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{data}" for _, _, data in commits])
        if len(commits) == 1:
            return rows
        order = F.create_map(*[x for version, _, data in commits for x in (F.lit(data), F.lit(version))])
        made = rows.withColumn("_version", order[F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)])
        newest = made.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), "_version").alias("row"))
        return newest.select("row.*")

    def commit(self, rows: DataFrame, base: int, kind: str = "change") -> int:
        """Make version ``base + 1`` of version ``base`` and the changed or new ``rows``; ``Conflict`` if it exists."""
        data = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).coalesce(1).write.parquet(f"{self.path}/data/{data}")
        self._publish(base + 1, kind, data)
        return base + 1

    def change(self, rows_of: Callable[[DataFrame], DataFrame]) -> int:
        """Commit what ``rows_of`` makes of the newest version; made again if another writer was first."""
        for _ in range(ATTEMPTS):
            base = self.version()
            try:
                made = self.commit(rows_of(self.read(base)), base)
            except Conflict:
                continue
            if made % COMPACT == 0:
                self.compact()
            return made
        raise Conflict(f"{ATTEMPTS} attempts to change {self.path} met other writers")

    def compact(self) -> None:
        """One more version with a full copy of the newest; left to others if one of them writes meanwhile."""
        base = self.version()
        try:
            self.commit(self.read(base), base, "full")
        except Conflict:
            pass
