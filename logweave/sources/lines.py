"""Numbered lines of text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.operators.joins import lookup_join


def read_log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(source_path, LineID, raw)``: LineID is the 1-based position in its file, blank lines are NULL.

    Lines are numbered without a global sort: each file split counts its lines, the running total of
    the splits before it is its offset, and a line adds its position within the split.
    """
    text = (
        spark.read.option("lineSep", "\n")
        .text(paths if isinstance(paths, str) else list(paths))
        .select(
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_pos"),
            F.nullif(F.col("value"), F.lit("")).alias("raw"),
        )
    )
    split = ["source_path", "_start"]
    before = Window.partitionBy("source_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        text.groupBy(*split)
        .agg(F.min("_pos").alias("_first"), F.count("*").alias("_lines"))
        .withColumn("_offset", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    )
    # one row per split, so some hundred bytes for every 128 MB of text
    numbered = lookup_join(text, offsets, split, weight="_lines", how="left", max_bytes=512 << 20)
    # the splits are planned once for the counts and once for the lines; if the session changes between
    # the two, fail rather than misnumber
    same = F.coalesce(F.shiftright("_pos", 33) == F.shiftright("_first", 33), F.lit(False))
    line_id = F.when(same, F.col("_offset") + F.col("_pos") - F.col("_first") + 1).otherwise(
        F.raise_error(F.lit("the file splits changed while lines were numbered")).cast("long")
    )
    return numbered.select("source_path", line_id.alias("LineID"), "raw")
