"""AEL: bins by token and parameter count, merged inside a bin."""

from __future__ import annotations

from operator import ne

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import WILDCARD, parameter_count, token_count, tokenize
from logweave.operators.joins import lookup_join
from logweave.operators.replay import BLOCK_LINES, Group, blocks_needed, replay, size_of
from logweave.session import materialize

BIN = ["_token_count", "_para_count"]


class LeaderMiner:
    """Contents of one bin join the first leader that differs in a small enough share of positions.

    Where at most k positions may differ, two contents that are cut into k + 1 segments agree in one of them. Leaders are
    looked up by their segments, so a content is compared only with leaders that share one.
    """

    def __init__(self, merge_thr: float):
        self.threshold = np.float32(merge_thr)
        self.most: dict[int, int] = {}
        self.sharing: dict[tuple, list[tuple[int, Group]]] = {}
        self.leaders = self.met = 0

    def _most(self, n: int) -> int:
        """The most positions of ``n`` that may differ; the share grows with their number."""
        if n not in self.most:
            self.most[n] = max((d for d in range(n + 1) if np.float32(d) / np.float32(n) <= self.threshold), default=-1)
        return self.most[n]

    def _segments(self, tokens: list[str]) -> list[tuple]:
        k = self._most(len(tokens)) + 1
        cuts = [len(tokens) * i // k for i in range(k + 1)] if k else []
        return [(len(tokens), i, *tokens[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def find(self, tokens: list[str]) -> Group | None:
        most, best, best_place = self._most(len(tokens)), None, self.leaders
        for segment in self._segments(tokens):
            for place, leader in self.sharing.get(segment, ()):
                if place >= best_place:
                    break
                self.met += 1
                if sum(map(ne, tokens, leader.tokens)) <= most:
                    best, best_place = leader, place
        return best

    def open(self, group: Group) -> bool:
        for segment in self._segments(group.tokens):
            self.sharing.setdefault(segment, []).append((self.leaders, group))
        self.leaders += 1
        return True

    def absorb(self, group: Group, tokens: list[str]) -> bool:
        return False


def mine_ael(
    df: DataFrame, cluster_thr: int = 2, merge_thr: float = 1.0, block_lines: int = BLOCK_LINES, log: str | None = None
) -> DataFrame:
    """``df`` needs ``LineID``, ``MaskedContent`` and ``content``; ``log`` names a column that tells several logs apart."""
    bins = [*BIN, *([log] if log else [])]
    binned = df.withColumns(
        {
            "_token_count": token_count(tokenize(F.col("content"))),
            "_para_count": parameter_count(F.col("MaskedContent")),
        }
    )
    contents = materialize(
        binned.where(F.col("content").isNotNull())
        .groupBy(*bins, "content")
        .agg(F.min("LineID").alias("LineID"), F.count("*").alias("n"))
    )
    sizes = materialize(contents.groupBy(*bins).agg(F.count("*").alias("contents"), F.sum("n").alias("n")))
    large = sizes.where(F.col("contents") > cluster_thr)
    if merge_thr >= 1:
        # any two contents of a bin may merge, so the bin is the group and lines need no content join
        merged = _merge(_of(contents, large, bins), bins)
        joined = lookup_join(binned, sizes.join(merged, bins, "left").drop("contents"), bins, "n", how="left")
        return joined.withColumn("Template", F.coalesce("Template", "content")).drop(*BIN)

    wide = materialize(_of(contents, large, bins).withColumn("route", F.concat_ws(" ", *bins)))
    routed = wide.select("route", F.lit(0).alias("level"), "LineID", "content")
    n_blocks = blocks_needed(*size_of(routed), block_lines)
    led = materialize(
        replay(routed, lambda level: LeaderMiner(merge_thr), n_blocks).select("route", "LineID", "leader")
    )
    group = ["route", "leader"]
    grouped = wide.join(led, ["route", "LineID"])
    sizes_of_groups = led.groupBy(*group).agg(F.count("*").alias("copies"))
    templates = _merge(grouped, group).join(sizes_of_groups, group)
    by_content = lookup_join(grouped, templates, group, weight="copies").select(*bins, "content", "Template", "n")
    marked = lookup_join(contents, large.drop("n").withColumn("_large", F.lit(True)), bins, weight="contents", how="left")
    small = marked.where(F.col("_large").isNull()).select(
        *bins, "content", F.col("content").alias("Template"), "n"
    )
    return lookup_join(
        binned, by_content.unionByName(small), [*bins, "content"], weight="n", how="left"
    ).drop(*BIN)


def _of(contents: DataFrame, large: DataFrame, bins: list[str]) -> DataFrame:
    """The contents of large bins; a bin may hold most of them, so they are not dealt by it."""
    return lookup_join(contents, large.drop("n"), bins, weight="contents")


def _merge(contents: DataFrame, group: list[str]) -> DataFrame:
    """One template per group: a position is kept if all contents agree on it.

    Contents are compared with one of their group, so only the places where they differ are counted and no text is sorted.
    """
    hashed = contents.select(*group, "content", F.xxhash64("content").alias("_hash"))
    least = hashed.groupBy(*group).agg(F.min("_hash").alias("_least"), F.count("*").alias("_n"))
    picked = lookup_join(hashed, least, group, weight="_n").where("_hash = _least")
    firsts = picked.groupBy(*group).agg(F.min("content").alias("_one"))
    firsts = materialize(firsts.join(least.select(*group, "_n"), group))
    beside = lookup_join(contents.select(*group, "content"), firsts, group, weight="_n")
    differs = F.zip_with(tokenize(F.col("content")), tokenize(F.col("_one")), lambda a, b: a != b)
    places = F.filter(F.transform(differs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    varied = beside.select(*group, F.explode(places).alias("col")).distinct()
    varied = varied.groupBy(*group).agg(F.collect_list("col").alias("_varied"))
    shown = F.transform(tokenize(F.col("_one")), lambda t, i: F.when(F.array_contains("_varied", i), F.lit(WILDCARD)).otherwise(t))
    template = F.when(F.col("_varied").isNull(), F.col("_one")).otherwise(F.array_join(shown, " "))
    return firsts.drop("_n").join(varied, group, "left").select(*group, template.alias("Template"))
