"""The log registry: one row per log, as operations on a DataFrame.

Deleted rows stay as tombstones, so an id is never given twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import name_matches, status
from logweave.operators.joins import lookup_join
from logweave.operators.sequence import with_rank

STORED = (
    "id long, format_type string, log_path string, create_time timestamp, is_extracted boolean,"
    " extract_method string, line_count long, deleted boolean"
)
UPDATABLE = {"format_type": str, "is_extracted": bool, "extract_method": str, "line_count": int}
ADDED, DUPLICATE = 0, -1


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORED)


def logs(registry: DataFrame) -> DataFrame:
    """Live rows with the names of their two tables."""
    return registry.where(~F.col("deleted")).drop("deleted").withColumns(
        {
            "structured_table_name": F.concat(F.lit("s_"), F.col("id").cast("string")),
            "templates_table_name": F.concat(F.lit("t_"), F.col("id").cast("string")),
        }
    )


def extracted_logs(registry: DataFrame) -> DataFrame:
    return logs(registry).where("is_extracted").select(
        "id", "log_path", "structured_table_name", "templates_table_name"
    )


def insert_outcome(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``(position, log_path)`` to insert, with ``code`` 0 for a new path and -1 for a known one."""
    known = registry.where(~F.col("deleted")).select("log_path", F.lit(True).alias("known"))
    firsts = (
        new.groupBy("log_path")
        .agg(F.min("position").alias("first"), F.count("*").alias("n"))
        .join(known, "log_path", "left")
    )
    repeated = F.col("known") | (F.col("position") > F.col("first"))
    return lookup_join(new, firsts, "log_path", weight="n").select(
        "position", "log_path", F.when(repeated, DUPLICATE).otherwise(ADDED).alias("code")
    )


def insert_logs(registry: DataFrame, new: DataFrame, create_time: Column | None = None) -> DataFrame:
    """The registry with the new paths of ``new(position, log_path)`` behind its highest id."""
    last = registry.agg(F.max("id")).first()[0] or 0
    when = F.date_trunc("second", F.current_timestamp() if create_time is None else create_time)
    fresh = with_rank(insert_outcome(registry, new).where(F.col("code") == ADDED), [F.asc("position")], "rank")
    return registry.unionByName(
        fresh.select(
            (F.col("rank") + 1 + last).alias("id"),
            F.lit("").alias("format_type"),
            "log_path",
            when.alias("create_time"),
            F.lit(False).alias("is_extracted"),
            F.lit("").alias("extract_method"),
            F.lit(0).cast("long").alias("line_count"),
            F.lit(False).alias("deleted"),
        )
    )


def update_log(registry: DataFrame, log_id: int, column: str, value) -> DataFrame:
    if column not in UPDATABLE:
        raise ValueError(f"{column!r} cannot be updated, only {sorted(UPDATABLE)}")
    if not isinstance(value, UPDATABLE[column]):
        raise ValueError(f"{column} takes {UPDATABLE[column].__name__}, not {value!r}")
    target = (F.col("id") == log_id) & ~F.col("deleted")
    new = F.lit(value).cast(registry.schema[column].dataType)
    return registry.withColumn(column, F.when(target, new).otherwise(F.col(column)))


def delete_log(registry: DataFrame, log_id: int) -> DataFrame:
    return registry.withColumn("deleted", F.col("deleted") | (F.col("id") == log_id))


def sort_order(column: str, descending: bool = False) -> list[Column]:
    """By a column or the derived ``status``; NULLs last, first when descending; ties by id."""
    key = F.when(F.col("is_extracted"), 0).otherwise(1) if column == "status" else F.col(column)
    return [key.desc_nulls_first() if descending else key.asc_nulls_last(), F.asc("id")]


def sort_logs(shown: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return shown.orderBy(*sort_order(column, descending))


def search_logs(shown: DataFrame, keyword: str) -> DataFrame:
    return shown.where(name_matches(F.col("log_path"), keyword))


def with_status(shown: DataFrame) -> DataFrame:
    return shown.withColumn("status", status(F.col("is_extracted")))
