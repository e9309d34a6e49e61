"""Filtering, paging and value histograms of a table."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.text import contains_keyword, in_all
from logweave.operators.sequence import with_rank

Filters = dict[str, Sequence[str]]
RANGES = 1 << 14  # ranges of positions in the directory of a table


def filtered(df: DataFrame, filters: Filters | None = None) -> DataFrame:
    return df.where(in_all(filters)) if filters else df


class Pages:
    """Pages of a filtered table in the order of ``position``, a whole number that no two rows share.

    A directory holds how many rows lie in each of at most ``RANGES`` ranges of positions, from one pass over the
    columns that filters and position need. A page is found in it and reads the ranges it lies in, wherever it is: the bounds are
    plain filters on the position, which files that are ordered by it skip by their statistics.
    """

    def __init__(self, df: DataFrame, filters: Filters | None = None, position: str = "LineID", ranges: int = RANGES):
        self.rows, self.position = filtered(df, filters), F.col(f"`{position}`")
        low, high = self.rows.agg(F.min(self.position), F.max(self.position)).first()
        self.total, self.bounds, self.before = 0, [], []
        if low is None:
            return
        width = -(-(high - low + 1) // ranges)
        place = F.floor((self.position - F.lit(low)) / F.lit(width)) if width > 1 else self.position - F.lit(low)
        for number, n in sorted(map(tuple, self.rows.groupBy(place.alias("range")).agg(F.count("*")).where("range is not null").collect())):
            self.bounds.append(low + number * width)
            self.before.append(self.total)
            self.total += n
        self.bounds.append(high + 1)

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset … offset + limit - 1``; all behind the offset for ``limit=-1``."""
        if offset >= self.total or not limit:
            return self.rows.limit(0)
        first = bisect_right(self.before, offset) - 1
        last = len(self.before) if limit < 0 else bisect_left(self.before, offset + limit)
        inside = self.rows.where((self.position >= self.bounds[first]) & (self.position < self.bounds[last])).orderBy(self.position)
        skipped = offset - self.before[first]
        if limit >= 0:
            return inside.offset(skipped).limit(limit)
        begin = inside.select(self.position).offset(skipped).limit(1).first()[0] if skipped else self.bounds[first]
        return inside.where(self.position >= begin)


def page(
    df: DataFrame, offset: int, limit: int, filters: Filters | None = None, order: Sequence[str | Column] = ("LineID",)
) -> DataFrame:
    """Rows ``offset … offset + limit - 1`` of the filtered table in ``order``, which must be total.

    ``limit=-1`` takes all rows behind the offset. In the order of one whole number a directory of its ranges leads to the page
    (keep ``Pages`` to look at several); other orders are a distributed sort.
    """
    if len(order) == 1 and isinstance(order[0], str) and df.schema[order[0]].dataType in (T.LongType(), T.IntegerType()):
        return Pages(df, filters, order[0]).page(offset, limit)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    place = F.col("_place")
    wanted = place >= offset if limit < 0 else (place >= offset) & (place < offset + limit)
    return with_rank(filtered(df, filters), keys, "_place").where(wanted).orderBy("_place").drop("_place")


def next_page(
    df: DataFrame, after: int, limit: int, filters: Filters | None = None, position: str = "LineID"
) -> DataFrame:
    """The page behind row ``after``; the position filter reaches the scan, so deep pages cost no more."""
    return filtered(df, filters).where(F.col(position) > after).orderBy(position).limit(limit)


def row_count(df: DataFrame, filters: Filters | None = None) -> int:
    return filtered(df, filters).count()


def value_histogram(
    df: DataFrame, column: str, keyword: str = "", filters: Filters | None = None, ignore_case: bool = True
) -> DataFrame:
    """Values of a column and their counts, most frequent first, under a keyword and the other filters.

    A filter on the column itself is left out. ``ignore_case=False`` lowers the keyword and compares
    case-sensitively, so upper-case values are never found.
    """
    others = {c: v for c, v in (filters or {}).items() if c != column}
    rows = filtered(df, others)
    keyword = keyword.strip().lower()
    if keyword:
        rows = rows.where(contains_keyword(F.col(f"`{column}`"), keyword, ignore_case))
    counts = rows.groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("Count"))
    return counts.orderBy(F.desc("Count"), F.asc(f"`{column}`"))


def value_page(
    df: DataFrame, column: str, offset: int, limit: int, keyword: str = "", filters: Filters | None = None, ignore_case: bool = True
) -> tuple[DataFrame, int]:
    """A page of ``value_histogram`` and the number of its values on all pages."""
    values = value_histogram(df, column, keyword, filters, ignore_case)
    return page(values, offset, limit, order=(F.desc("Count"), F.asc(f"`{column}`"))), values.count()
