"""Brain: wildcards from token frequencies. Independent of line order, so it is plain relational work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import WILDCARD, tokenize
from logweave.operators.joins import lookup_join
from logweave.session import materialize

ROOT_SHARE = 0.5  # a root is at least this share of the line's highest frequency


def mine_brain(df: DataFrame, var_thr: int = 2, log: str | None = None) -> DataFrame:
    """Work on distinct contents with their number of lines, then join the templates back to the lines.

    ``log`` names a column that tells several logs apart; each is mined as if it were alone.
    """
    own = [log] if log else []
    contents = materialize(
        df.where(F.col("content").isNotNull())
        .groupBy(*own, "content")
        .agg(F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    rooted = materialize(_with_root(_with_frequencies(contents, own)))
    family = [*own, "length", "root_freq", "root_count"]
    wild = _wildcard_columns(rooted, family, var_thr)
    text = F.array_join(
        F.transform("cells", lambda c: F.when(F.array_contains("wild", c["col"]), F.lit(WILDCARD)).otherwise(c["token"])),
        " ",
    )
    templates = lookup_join(rooted, wild, family, weight="members").select(
        *own,
        F.array_join(F.transform("cells", lambda c: c["token"]), " ").alias("content"),
        text.alias("Template"),
        "n",
    )
    return lookup_join(df, templates, [*own, "content"], weight="n", how="left")


def _with_frequencies(contents: DataFrame, own: list[str]) -> DataFrame:
    """Per content its cells ``(col, token, freq)``: lines of that length with that token in that column."""
    cells = contents.withColumn("tokens", tokenize(F.col("content"))).select(
        *own, "id", "n", F.size("tokens").alias("length"), F.posexplode("tokens").alias("col", "token")
    )
    place = [*own, "length", "col", "token"]
    frequency = cells.groupBy(*place).agg(F.sum("n").alias("freq"), F.count("*").alias("copies"))
    return (
        lookup_join(cells, frequency, place, weight="copies")
        .groupBy("id", *own, "n", "length")
        .agg(F.array_sort(F.collect_list(F.struct("col", "token", "freq"))).alias("cells"))
        .drop("id")
    )


def _with_root(rows: DataFrame) -> DataFrame:
    """The frequency that most cells share, among those at least half the highest; ties take the lowest."""
    rows = rows.withColumn("freqs", F.transform("cells", lambda c: c["freq"]))
    least = F.array_max("freqs").cast("float") * F.lit(ROOT_SHARE).cast("float")
    candidates = F.filter(F.array_distinct("freqs"), lambda f: f.cast("float") >= least)
    root = F.array_max(
        F.transform(
            candidates,
            lambda f: F.struct(F.size(F.filter("freqs", lambda x: x == f)).alias("count"), (-f).alias("minus_freq")),
        )
    )
    return (
        rows.withColumn("root", root)
        .withColumns({"root_count": F.col("root.count"), "root_freq": -F.col("root.minus_freq")})
        .drop("root", "freqs")
    )


def _wildcard_columns(rooted: DataFrame, family: list[str], var_thr: int) -> DataFrame:
    """Per family the columns that vary: two aggregations, so a family with many tokens spreads out."""
    cells = rooted.select(*family, F.explode("cells").alias("cell")).select(*family, "cell.*")
    columns = (
        cells.groupBy(*family, "col", "token")
        .agg(F.max("freq").alias("freq"), F.count("*").alias("members"))
        .groupBy(*family, "col")
        .agg(F.max("freq").alias("freq"), F.count("*").alias("tokens"), F.sum("members").alias("members"))
    )
    parent = (F.col("freq") > F.col("root_freq")) & (F.col("tokens") > 1)
    child = (F.col("freq") < F.col("root_freq")) & (F.col("tokens") >= var_thr)
    return columns.groupBy(*family).agg(
        F.collect_list(F.when(parent | child, F.col("col"))).alias("wild"), F.max("members").alias("members")
    )
