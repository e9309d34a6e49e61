"""The one join shape that must survive hot keys: many rows against a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.session import materialize

BROADCAST_BYTES = 16 << 20  # the driver holds a broadcast about four times over, and those of several steps at once
TASK_ROWS = 1_000_000  # the rows of a key beyond this many are spread over further tasks


def _row_bytes(table: DataFrame) -> Column:
    def width(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(field.dataType, T.ArrayType):
            text = column.cast("string")  # counts the elements with their separators
            return F.coalesce(F.octet_length(text) + 8 * F.size(column), F.lit(0)) + 16
        return F.lit(16)

    return reduce(lambda a, b: a + b, [width(f) for f in table.schema.fields])


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: str | Sequence[str],
    weight: str,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` to ``table``, whose ``weight`` column holds the number of rows per key.

    The table is written once and measured. Within ``max_bytes`` it is broadcast and ``rows`` do not
    move. Beyond, it is a shuffle join in which the rows of a key are spread over as many salts as it fills
    tasks of ``TASK_ROWS`` rows, and the table row of that key is copied to each. The weight column is dropped.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    table = materialize(table)
    size = table.agg(F.sum(_row_bytes(table)).alias("bytes")).first()
    if (size["bytes"] or 0) <= max_bytes:
        return rows.join(F.broadcast(table.drop(weight)), keys, how)
    salts = F.ceil(F.col(weight) / TASK_ROWS).cast("int")
    # keys of more than one task: no more of them than tasks, a millionth of the rows
    hot_keys = table.where(salts > 1).select(*keys, salts.alias("_salts"))
    salted_rows = rows.join(F.broadcast(hot_keys), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    copies = F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)
    salted_table = table.withColumn("_salt", F.explode(copies)).drop(weight)
    return salted_rows.join(salted_table, [*keys, "_salt"], how).drop("_salt", "_salts")
