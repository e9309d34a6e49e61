"""What the operators of this folder share: batches, stored steps, spans as text."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logweave.session import shared_dir, ship

ROWS_PER_BATCH = 1024
BYTES_PER_BATCH = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _given_back(fn):
    """``fn``, and the memory that it freed returned to the system at the end of the task: workers are shared by all stages."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``ROWS_PER_BATCH`` rows and about ``BYTES_PER_BATCH``, so that long texts fit a worker."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= ROWS_PER_BATCH:
        conf.set(_BATCH, str(ROWS_PER_BATCH))
    if not 0 < int(conf.get(_BYTES).rstrip("b")) <= BYTES_PER_BATCH:
        conf.set(_BYTES, str(BYTES_PER_BATCH))
    return df.mapInArrow(_given_back(fn), schema)


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with the columns of the DDL text ``more`` behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that are called like working columns; ``put_back`` undoes it."""
    taken = {f"_own_{i}_{c}": c for i, c in enumerate(df.columns) if c.lower() in names}
    return df.withColumnsRenamed({c: new for new, c in taken.items()}), taken


def put_back(df: DataFrame, taken: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(taken)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the scan of it.

    The scan survives lost executors. The shuffle files of the write are removed when it ends, so that
    an operator of several steps needs the disk of its largest step, not of all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._stored_at = path
    return scan


def release(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def grouped_by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of ``column`` in batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(column))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(column)[0].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null becomes the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` places where its values begin; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return content[places[0] : places[-1]], places - places[0]


def slices(places: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each; a row is never cut."""
    first = 0
    while first < len(places) - 1:
        last = int(np.searchsorted(places, places[first] + size, "right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def joined_spans(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
