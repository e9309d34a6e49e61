"""A set of 64-bit keys of bounded size, built by Spark for broadcasting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import grouped_by, map_batches
from logweave.llm.hashing import mix

TABLE_BITS = 29  # 64 MB
ROOM = 1 << TABLE_BITS - 4


@dataclass
class BitTable:
    """Answers whether a key was put in; it may say yes for others, rarely while there are fewer than ``ROOM`` keys."""

    bits: int
    table: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame, count: int) -> BitTable:
        bits = min(TABLE_BITS, max(16, int(64 * count).bit_length()))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = cls._places(np.asarray(batch.column(0)), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(at))], ["at"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in grouped_by(batches, "chunk"):
                flags = np.zeros(1 << 16, np.uint8)
                flags[group.column("at").to_numpy() & 0xFFFF] = 1
                yield pa.RecordBatch.from_arrays([group.column("chunk").combine_chunks()[:1], pa.array([np.packbits(flags).tobytes()])], ["chunk", "packed"])

        placed = map_batches(keys.select("key"), place, "at bigint").distinct().withColumn("chunk", F.shiftright("at", 16))
        packed = map_batches(placed.select("at", "chunk").repartition("chunk").sortWithinPartitions("chunk"), pack, "chunk bigint, packed binary")
        table = np.zeros(1 << (bits - 3), np.uint8)
        for row in packed.toLocalIterator():
            table[row.chunk << 13 : (row.chunk + 1) << 13] = np.frombuffer(row.packed, np.uint8)
        return cls(bits, table)

    @staticmethod
    def _places(keys: np.ndarray, bits: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys, self.bits)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
