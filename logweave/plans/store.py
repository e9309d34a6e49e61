"""Registered logs and their stored tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.config import FormatConfig
from logweave.plans.extract import Extraction, _files, extract_file, extract_files
from logweave.sources import registry as reg
from logweave.sources.versions import VersionedTable


_SCHEME = r"^(\w+):/+"


class LogStore:
    """A registry of logs, changed version by version, plus ``s_<id>`` / ``t_<id>`` tables per extracted log."""

    def __init__(self, spark: SparkSession, registry_table: str = "log", path: str | None = None):
        """``path`` is the folder of the registry, by default one of that name beside the tables of the session."""
        self.spark = spark
        self.registry = VersionedTable(spark, path or f"{spark.conf.get('spark.sql.warehouse.dir')}/{registry_table}.registry", reg.STORED)

    # registry

    def _registry(self) -> DataFrame:
        return self.registry.read()

    def logs(self) -> DataFrame:
        return reg.logs(self._registry())

    def extracted_logs(self) -> DataFrame:
        return reg.extracted_logs(self._registry())

    def add(self, paths: Sequence[str]) -> list[int]:
        """One code per path: 0 added, -1 already registered."""
        new = self.spark.createDataFrame(list(enumerate(paths)), "position long, log_path string")
        codes: list[int] = []

        def added(registry: DataFrame) -> DataFrame:
            codes[:] = [r["code"] for r in reg.insert_outcome(registry, new).orderBy("position").collect()]
            last = registry.agg(F.max("id")).first()[0] or 0
            return reg.insert_logs(registry, new).where(F.col("id") > last)

        self.registry.change(added)
        return codes

    def update(self, log_id: int, column: str, value) -> None:
        self._update([log_id], {column: lambda _: value})

    def _update(self, log_ids: Sequence[int], values: dict) -> None:
        """Set columns of several logs in one version; a value is a function of the id."""

        def updated(registry: DataFrame) -> DataFrame:
            for log_id in log_ids:
                for column, value in values.items():
                    registry = reg.update_log(registry, log_id, column, value(log_id))
            return registry.where(F.col("id").isin(*log_ids))

        self.registry.change(updated)

    def delete(self, log_id: int) -> None:
        self.registry.change(lambda registry: reg.delete_log(registry, log_id).where(F.col("id") == log_id))
        self.drop_table(f"s_{log_id}")
        self.drop_table(f"t_{log_id}")

    # extraction

    def _paths(self, log_ids: Sequence[int]) -> dict[int, str]:
        found = {r["id"]: r["log_path"] for r in self.logs().where(F.col("id").isin(*log_ids)).select("id", "log_path").collect()}
        for log_id in log_ids:
            if log_id not in found:
                raise ValueError(f"no log with id {log_id}")
        return found

    def extract(self, log_id: int, config: FormatConfig, miner: str = "Drain", **options) -> int:
        """Extract one registered log, write its two tables and return its number of lines."""
        result = extract_file(self.spark, self._paths([log_id])[log_id], config, miner=miner, **options)
        self.write(log_id, result)
        return self._extracted([log_id], config, miner)[log_id]

    def extract_many(self, log_ids: Sequence[int], config: FormatConfig, miner: str = "Drain", **options) -> dict[int, int]:
        """The same for several logs of one format, each a file: one extraction and one new version of the registry."""
        paths = self._paths(log_ids)
        files = {log_id: _files(self.spark, path) for log_id, path in paths.items()}
        for log_id, found in files.items():
            if len(found) != 1:
                raise ValueError(f"log {log_id} is not one file")
        result = extract_files(self.spark, list(paths.values()), config, miner=miner, **options)
        for log_id in log_ids:
            # the two ways to ask Spark for the name of a file differ in the slashes behind the scheme
            name = re.sub(_SCHEME, r"\1:/", files[log_id][0])
            own = F.regexp_replace("source_path", _SCHEME, "$1:/") == name
            self.write(log_id, Extraction(result.structured.where(own).drop("source_path"), result.templates.where(own).drop("source_path")))
        return self._extracted(log_ids, config, miner)

    def _extracted(self, log_ids: Sequence[int], config: FormatConfig, miner: str) -> dict[int, int]:
        lines = {log_id: self.row_count(f"s_{log_id}") for log_id in log_ids}
        values = {"format_type": config.name, "extract_method": miner, "is_extracted": True}
        self._update(log_ids, {**{k: (lambda _, v=v: v) for k, v in values.items()}, "line_count": lines.get})
        return lines

    def write(self, log_id: int, result: Extraction) -> None:
        result.structured.write.mode("overwrite").saveAsTable(f"s_{log_id}")
        result.templates.write.mode("overwrite").saveAsTable(f"t_{log_id}")

    # tables

    def structured(self, log_id: int) -> DataFrame:
        return self.spark.table(f"s_{log_id}")

    def templates(self, log_id: int) -> DataFrame:
        return self.spark.table(f"t_{log_id}")

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def has_column(self, name: str, column: str) -> bool:
        return column in self.columns(name)

    def columns(self, name: str) -> list[str]:
        return self.spark.table(name).columns

    def row_count(self, name: str) -> int:
        return self.spark.table(name).count()

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
