"""Positions and neighbours in a sequence, without one global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import materialize

BLOCK = 1 << 18


def with_next(
    rows: DataFrame,
    position: str,
    columns: Sequence[str],
    partition_by: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Add ``_next``, a struct of ``columns`` of the row with the next higher ``position``.

    Equal to ``lead`` over the whole table ordered by ``position`` (per ``partition_by`` if given).
    Positions are unique but may have gaps. Rows are cut into blocks of ``block`` positions, so no task
    holds more than ``block`` rows of a sequence; the last row of a block takes the head of the next
    block that has rows, found by the same operator on the much smaller table of heads.
    """
    part = []
    if partition_by:
        # one struct for all partition columns: unlike a plain column it is never NULL, so that joins on
        # it are plain equalities and keep the partitioning of the window
        rows, part = rows.withColumn("_part", F.struct(*partition_by)), ["_part"]
    blocked = rows.withColumn("_block", F.floor(F.col(position) / block).cast("long")).repartition(*part, "_block")
    return _fill(blocked, position, list(columns), part, block, levels=2).drop("_block", *part)


def _fill(
    rows: DataFrame, position: str, columns: list[str], part: list[str], block: int, levels: int
) -> DataFrame:
    key = [*part, "_block"]
    value = F.struct(*columns)
    inside = rows.withColumn("_next", F.lead(value).over(Window.partitionBy(*key).orderBy(position)))
    heads = rows.groupBy(*key).agg(F.min_by(value, position).alias("_head"))
    if levels == 1:
        # one row per block² positions
        over = Window.partitionBy(*part).orderBy("_block")
        following = heads.select(*key, F.lead("_head").over(over).alias("_after"))
    else:
        upper = (
            heads.withColumnRenamed("_block", "_position")
            .withColumn("_block", F.floor(F.col("_position") / block).cast("long"))
            .repartition(*key)
        )
        following = _fill(upper, "_position", ["_head"], part, block, levels - 1).select(
            *part, F.col("_position").alias("_block"), F.col("_next._head").alias("_after")
        )
    return inside.join(following, key, "left").withColumn("_next", F.coalesce("_next", "_after")).drop("_after")


def with_rank(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows from 0 in ``order``, which must be total.

    A distributed sort: rows are range-partitioned, numbered inside their partition, and shifted by the
    number of rows in the partitions before. The shifts are one row per partition.
    """
    parts = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_place", place)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, (F.col("_place") - 1 + F.col("_shift")).cast("long"))
        .drop("_part", "_place", "_shift")
    )
