"""Counts over time and levels, and the template matrices, all in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.timing import DEFAULT_WIDTH, WIDTHS, Width, bucket_number, bucket_seconds, epoch_micros
from logweave.operators.joins import lookup_join
from logweave.operators.sequence import with_next
from logweave.session import materialize

TILE = 1024  # co-occurrence compares templates in tiles of this side


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"the structured table has no {column} column")


def log_counts(structured: DataFrame, templates: DataFrame) -> DataFrame:
    """The two headline numbers: lines and templates."""
    lines = structured.agg(F.count("*").alias("n")).select(F.lit("lines").alias("name"), "n")
    return lines.unionByName(templates.agg(F.count("*").alias("n")).select(F.lit("templates").alias("name"), "n"))


def level_distribution(structured: DataFrame) -> DataFrame:
    _require(structured, "Level")
    return structured.groupBy("Level").agg(F.count("*").alias("Count")).orderBy("Level")


def log_frequency(structured: DataFrame, width: Width | str = DEFAULT_WIDTH) -> DataFrame:
    """Lines per bucket."""
    bucket = bucket_seconds(F.col("Timestamp"), width).alias("bucket")
    return structured.groupBy(bucket).agg(F.count("*").alias("Count"))


def template_frequency(
    structured: DataFrame, width: Width | str = DEFAULT_WIDTH, approximate: bool = False
) -> DataFrame:
    """Distinct templates per bucket."""
    bucket = bucket_seconds(F.col("Timestamp"), width).alias("bucket")
    distinct = F.approx_count_distinct("Template") if approximate else F.count_distinct("Template")
    return structured.groupBy(bucket).agg(distinct.alias("Count"))


def level_frequency(structured: DataFrame, width: Width | str = DEFAULT_WIDTH) -> DataFrame:
    """Lines per level and bucket."""
    _require(structured, "Level")
    bucket = bucket_seconds(F.col("Timestamp"), width).alias("bucket")
    return structured.groupBy("Level", bucket).agg(F.count("*").alias("Count"))


def finest_counts(structured: DataFrame) -> DataFrame:
    """``(second, Level, Template, n)``: the one scan of the lines that all roll-ups are made from; written once.

    ``second`` starts the finest bucket; every width is a multiple of it or whole days or months.
    """
    level = F.col("Level") if "Level" in structured.columns else F.lit(None).cast("string")
    second = bucket_seconds(F.col("Timestamp"), "1 second").alias("second")
    return materialize(structured.groupBy(second, level.alias("Level"), "Template").agg(F.count("*").alias("n")))


def _in_widths(fine: DataFrame, widths: Sequence[str]) -> DataFrame:
    """Each row once per width, with the bucket it falls into there."""
    at = F.timestamp_seconds("second")
    buckets = F.array(*[F.struct(F.lit(w).alias("width"), bucket_seconds(at, w).alias("bucket")) for w in widths])
    return fine.withColumn("_b", F.explode(buckets)).select("_b.width", "_b.bucket", *[c for c in fine.columns if c != "second"])


def log_roll_up(fine: DataFrame, widths: Sequence[str] = tuple(WIDTHS)) -> DataFrame:
    """``(width, bucket, Count)``: ``log_frequency`` of all widths, from ``finest_counts``."""
    return _in_widths(fine.groupBy("second").agg(F.sum("n").alias("n")), widths).groupBy("width", "bucket").agg(F.sum("n").alias("Count"))


def level_roll_up(fine: DataFrame, widths: Sequence[str] = tuple(WIDTHS)) -> DataFrame:
    """``(width, Level, bucket, Count)``: ``level_frequency`` of all widths."""
    seconds = fine.groupBy("second", "Level").agg(F.sum("n").alias("n"))
    return _in_widths(seconds, widths).groupBy("width", "Level", "bucket").agg(F.sum("n").alias("Count"))


def template_roll_up(fine: DataFrame, widths: Sequence[str] = tuple(WIDTHS), approximate: bool = False) -> DataFrame:
    """``(width, bucket, Count)``: ``template_frequency`` of all widths.

    Distinct counts do not add up, so the exact form carries the templates of a second to every width. The approximate one makes
    a sketch a second and merges sketches, whose size does not grow with the templates.
    """
    if approximate:
        sketches = fine.groupBy("second").agg(F.hll_sketch_agg("Template").alias("sketch"))
        merged = _in_widths(sketches, widths).groupBy("width", "bucket").agg(F.hll_union_agg("sketch").alias("sketch"))
        return merged.select("width", "bucket", F.hll_sketch_estimate("sketch").alias("Count"))
    templates = fine.select("second", "Template").distinct()
    return _in_widths(templates, widths).groupBy("width", "bucket").agg(F.count_distinct("Template").alias("Count"))


def with_template_id(structured: DataFrame, templates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns of every line that has a template, plus its ``template_id``."""
    columns = list(dict.fromkeys([*columns, "Template"]))
    return lookup_join(structured.select(*columns), templates, "Template", weight="Count").drop("Template")


def template_transition(
    structured: DataFrame, templates: DataFrame, partition_by: Sequence[str] = ()
) -> DataFrame:
    """``(i, j, value)``: how often template j follows template i in line order."""
    ids = with_template_id(structured, templates, ["LineID", *partition_by])
    steps = with_next(ids, "LineID", ["template_id"], partition_by).where(F.col("_next").isNotNull())
    return steps.groupBy(F.col("template_id").alias("i"), F.col("_next.template_id").alias("j")).agg(
        F.count("*").alias("value")
    )


def transition_probability(transition: DataFrame) -> DataFrame:
    """Each count as a share of its row."""
    row_total = F.sum("value").over(Window.partitionBy("i"))
    return transition.select("i", "j", (F.col("value") / row_total).alias("value"))


def template_dwell(structured: DataFrame, templates: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``(i, j, value)``: average time from template i to the following template j, in whole seconds."""
    ids = with_template_id(structured, templates, ["LineID", "Timestamp", *partition_by])
    ids = ids.withColumn("micros", epoch_micros(F.col("Timestamp"))).drop("Timestamp")
    steps = with_next(ids, "LineID", ["template_id", "micros"], partition_by).where(F.col("_next").isNotNull())
    gap = F.col("_next.micros") - F.col("micros")
    total, n = F.col("total"), F.col("n") * 1_000_000
    return (
        steps.groupBy(F.col("template_id").alias("i"), F.col("_next.template_id").alias("j"))
        .agg(F.sum(gap).alias("total"), F.count(gap).alias("n"))
        # % keeps the sign of the total, so this cuts toward zero without leaving integers
        .select("i", "j", F.when(F.col("n") > 0, ((total - total % n) / n).cast("long")).alias("value"))
    )


def template_cooccurrence(
    structured: DataFrame,
    templates: DataFrame,
    width: Width | str = DEFAULT_WIDTH,
    symmetric: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """``(i, j, value)`` with ``i < j``: buckets in which both templates occur; mirrored if ``symmetric``.

    Pairs are formed tile by tile: a join key never holds more than ``tile`` templates on either side,
    however many share a bucket. Where most templates recur from bucket to bucket, 64 neighbouring
    buckets are packed into the bits of one number, so that a pair is compared once per 64 buckets; which
    of the two makes fewer comparisons is counted first.
    """
    number = bucket_number(F.col("Timestamp"), width).alias("bucket")
    ids = with_template_id(structured, templates, ["Timestamp"]).select(number, F.col("template_id").alias("id"))
    present = materialize(ids.where(F.col("bucket").isNotNull()).distinct())
    pack, last_id = _packing(present)
    bit = F.expr(f"shiftleft(1L, cast(pmod(bucket, {pack}) as int))")
    marks = (
        present.groupBy(F.floor(F.col("bucket") / pack).alias("span"), "id")
        .agg(F.bit_or(bit).alias("bits"))
        .withColumn("tile", F.floor(F.col("id") / tile))
    )
    last = F.lit(last_id // tile)
    a = marks.select("span", F.col("id").alias("i"), F.col("bits").alias("a"), F.col("tile").alias("tile_i"))
    b = marks.select("span", F.col("id").alias("j"), F.col("bits").alias("b"), F.col("tile").alias("tile_j"))
    a = a.withColumn("tile_j", F.explode(F.sequence(F.col("tile_i"), last)))
    b = b.withColumn("tile_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile_j"))))
    counts = (
        a.join(b, ["span", "tile_i", "tile_j"])
        .where("i < j")
        .groupBy("i", "j")
        .agg(F.sum(F.bit_count(F.col("a").bitwiseAND(F.col("b")))).cast("long").alias("value"))
        .where("value > 0")
    )
    if not symmetric:
        return counts
    # both triangles in one pass
    return counts.select(
        F.explode(
            F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        ).alias("cell")
    ).select("cell.*")


def _packing(present: DataFrame) -> tuple[int, int]:
    """How many buckets to pack for the fewest comparisons, and the highest template id."""
    sizes = [F.struct(F.lit(p).alias("pack"), F.floor(F.col("bucket") / p).alias("span")) for p in (1, 64)]
    spans = present.select(F.explode(F.array(*sizes)).alias("s"), "id").select("s.*", "id").distinct()
    n = F.col("n").cast("double")
    costs = (
        spans.groupBy("pack", "span")
        .agg(F.count("*").alias("n"), F.max("id").alias("last"))
        .groupBy("pack")
        .agg(F.sum(n * n).alias("cost"), F.max("last").alias("last"))
    )
    best = costs.orderBy("cost", "pack").first()
    return (best["pack"], best["last"]) if best else (1, 0)


def dense(matrix: DataFrame, dim: int) -> DataFrame:
    """``(i, cells)``: one row per i, ``cells`` the ``dim`` values of its row, missing ones 0.

    A row is one array, so no dimension is too large for a plan. Each cell brings the zeros in front of it, so a row takes
    time in proportion to its length.
    """
    cells = F.array_sort(F.collect_list(F.struct("j", "value")))
    held = matrix.where((F.col("j") >= 0) & (F.col("j") < dim)).groupBy("i").agg(cells.alias("held"))
    rows = matrix.sparkSession.range(dim).select(F.col("id").alias("i")).join(held, "i", "left")
    nothing = F.lit(0).cast(matrix.schema["value"].dataType)

    def with_gap(cell: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1).cast("bigint")).otherwise(F.get(F.col("held"), k - 1)["j"])
        return F.concat(F.array_repeat(nothing, (cell["j"] - before - 1).cast("int")), F.array(cell["value"]))

    last = F.coalesce(F.get(F.col("held"), F.size("held") - 1)["j"], F.lit(-1))
    nothings = F.array().cast(f"array<{matrix.schema['value'].dataType.simpleString()}>")
    filled = F.coalesce(F.flatten(F.transform("held", with_gap)), nothings)
    return rows.select("i", F.concat(filled, F.array_repeat(nothing, (F.lit(dim - 1) - last).cast("int"))).alias("cells"))


def colour_scale(matrix: DataFrame) -> DataFrame:
    """99th percentile of the non-zero cells, the maximum, and both as log(1 + x); NULL when empty.

    Cells are first counted by value, so the percentile sees each distinct value once.
    """
    values = matrix.where("value > 0").groupBy("value").agg(F.count("*").alias("n"))
    scale = values.agg(F.percentile("value", F.lit(0.99), F.col("n")).alias("p99"), F.max("value").alias("max"))
    return scale.select("p99", "max", F.log1p("p99").alias("log_p99"), F.log1p("max").alias("log_max"))


def log_scaled(matrix: DataFrame) -> DataFrame:
    return matrix.select("i", "j", F.log1p("value").alias("value"))
