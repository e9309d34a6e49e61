"""Phrase collocations: depth-truncated suffix subtrees over words, built group by group under a memory budget.

*Words* are counted per language and text; the frequent ones get numbers in the order of (language, word). A phrase is
frequent only if all its words and all pairs of neighbours in it are, so texts become runs of numbers of frequent words,
cut at the ends of pieces and at rare words.

*Vertical partitioning.* Pairs of neighbours are counted. In their order, prefixes of two words are put into groups whose
suffixes add up to at most twice ``BUDGET``; a prefix that alone exceeds it is counted on by one more word, up to the depth
of five, and its longer prefixes are grouped instead. A group is a range, so what tasks need to know are the ends of groups
and the few prefixes beyond the budget.

*Subtrees.* Every suffix, truncated to five words and cut at the first rare pair, goes to its group, equal ones added up
before the shuffle. A group is sorted; rows that share their first words are a node of the truncated subtree, and the
totals of its leaves are its count.

The dictionary is broadcast up to ``DICTIONARY_BYTES``; beyond, words are numbered by a join. Frequent pairs are
broadcast as a bit table of at most 64 MB; pairs it takes for frequent by mistake cost time, not correctness.
Words are compared byte by byte wherever hashes bring them together. Scores are decimals of 38 digits, so products are
exact while ``1000 * a * n`` has no more.

Defined cases: a null text has no words, a null lang is ``und`` (and the same as the text ``und``); rows repeat as often
as they are there; ties end in the byte order of the phrase; nothing else of a row matters, its id may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.bits import BitTable
from logweave.llm.common import grouped_by, map_batches, release, slices, stored, utf8
from logweave.llm.hashing import mix, words
from logweave.operators.joins import lookup_join
from logweave.operators.sequence import with_rank

SUPPORT = 100
DEPTH = 5
TOP = 2000
BUDGET = 1_000_000  # suffixes of a group
DICTIONARY_BYTES = 256 << 20
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

# fixed values: the bytes that end a piece, and those between words
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

_ENDS = np.zeros(256, bool)
_ENDS[list(ENDS)] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class _Slice:
    """The words of some rows: their bytes, keys of (language, word), and whether a word follows the one before in its piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray  # of each word, a place in the list of languages
    keys: np.ndarray
    row: np.ndarray
    joined: np.ndarray


def _keys(hashes: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix((lang.astype(np.uint64) + np.uint64(1)) << np.uint64(32)))


def _slices(batch: pa.RecordBatch, langs: list[str]) -> Iterator[_Slice]:
    """Word slices of a batch of (lang, text, ...); languages not in ``langs`` are added to it."""
    places_of = {name: i for i, name in enumerate(langs)}
    codes = np.empty(batch.num_rows, np.int64)
    for i, name in enumerate(batch.column(0).to_pylist()):
        name = UNKNOWN if name is None else name
        if name not in places_of:
            places_of[name] = len(langs)
            langs.append(name)
        codes[i] = places_of[name]
    data, places = utf8(batch.column(1))
    data = _LOWER[data]
    for a, b in slices(places, SLICE_BYTES):
        part = data[places[a] : places[b]]
        found = words(part, places[a : b + 1] - places[a], _BETWEEN)
        if not len(found.starts):
            continue
        row = found.row
        ends = np.cumsum(_ENDS[part], dtype=np.int32)[found.starts]
        joined = np.concatenate([[False], (ends[1:] == ends[:-1]) & (row[1:] == row[:-1])])
        lang = codes[a + row]
        yield _Slice(part, found.starts, found.ends, lang, _keys(found.hashes, lang), a + row, joined)


def _equal_bytes(data, starts, ends, other, at, until) -> np.ndarray:
    """Whether ``data[starts:ends]`` equals ``other[at:until]``, pair by pair."""
    size = ends - starts
    same = size == until - at
    rows = np.flatnonzero(same & (size > 0))
    size = size[rows]
    if len(rows):
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        differs = data[np.repeat(starts[rows], size) + step] != other[np.repeat(at[rows], size) + step]
        same[rows] = ~np.logical_or.reduceat(differs, first)
    return same


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)``; the row without a word holds the number of all words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        for batch in batches:
            for s in _slices(batch, langs):
                _, first, group, f = np.unique(s.keys, return_index=True, return_inverse=True, return_counts=True)
                like = first[group]
                same = _equal_bytes(s.data, s.starts, s.ends, s.data, s.starts[like], s.ends[like]) & (s.lang == s.lang[like])
                other = np.flatnonzero(~same)  # words that only share a key
                np.subtract.at(f, group[other], 1)
                at, f = np.concatenate([first, other]), np.concatenate([f, np.ones(len(other), f.dtype)])
                total = np.bincount(s.lang, minlength=len(langs))
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[i] for i in s.lang[at]] + [langs[i] for i in seen], pa.string()),
                        pa.array(_texts(s.data, s.starts[at], s.ends[at]) + [None] * len(seen), pa.string()),
                        pa.array(np.concatenate([f, total[seen]]).astype(np.int64)),
                    ],
                    ["lang", "word", "f"],
                )

    counted = map_batches(docs.select("lang", "text"), count, "lang string, word string, f bigint")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Dictionary:
    """Frequent words by key; a key may stand for several words."""

    langs: list[str]
    keys: np.ndarray
    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    copies: int = 1

    @classmethod
    def of(cls, rows: pa.Table) -> Dictionary:
        langs = sorted(set(rows.column("lang").to_pylist()))
        code = {name: i for i, name in enumerate(langs)}
        data, places = utf8(rows.column("word").combine_chunks())
        lang = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
        keys = _keys(words(data, places, _BETWEEN).hashes, lang)
        order = np.argsort(keys, kind="stable")
        copies = int(np.unique(keys, return_counts=True)[1].max()) if len(keys) else 1
        return cls(langs, keys[order], rows.column("id").to_numpy()[order], data, places[:-1][order], places[1:][order], copies)

    def look_up(self, s: _Slice) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(s.keys), -1, np.int64)
        if not len(self.keys):
            return out
        place = np.searchsorted(self.keys, s.keys)
        for more in range(self.copies):
            at = np.minimum(place + more, len(self.keys) - 1)
            rows = np.flatnonzero((out < 0) & (self.keys[at] == s.keys))
            at = at[rows]
            same = _equal_bytes(s.data, s.starts[rows], s.ends[rows], self.data, self.starts[at], self.ends[at])
            out[rows[same]] = self.ids[at[same]]
        return out


def _runs(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Numbers of words with -1 between runs; runs of one word are left out."""
    follows = joined & (ids >= 0) & (np.concatenate([[-1], ids[:-1]]) >= 0)
    inside = follows | np.concatenate([follows[1:], [False]])
    at = np.flatnonzero(inside)
    begins = ~follows[at]
    out = np.full(len(at) + int(begins.sum()), -1, np.int64)
    out[np.arange(len(at)) + np.cumsum(begins)] = ids[at]
    return out


_RUNS = "ids array<bigint>"


def _row_of(ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64()))], ["ids"])


def runs_by_broadcast(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``ids``: runs of numbers, the dictionary in every task."""
    shared = docs.sparkSession.sparkContext.broadcast(Dictionary.of(known.select("lang", "word", "id").toArrow()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        for batch in batches:
            for s in _slices(batch, list(dictionary.langs)):
                ids = _runs(dictionary.look_up(s), s.joined)
                if len(ids):
                    yield _row_of(ids)

    return map_batches(docs.select("lang", "text"), number, _RUNS)


def runs_by_join(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The same, words numbered by a join."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            own = batch.column(2).to_numpy()
            for s in _slices(batch, langs):
                at = np.cumsum(np.where(s.joined, 1, 2))  # a gap between pieces
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[i] for i in s.lang], pa.string()), pa.array(_texts(s.data, s.starts, s.ends), pa.string()), pa.array(own[s.row]), pa.array(at)],
                    ["lang", "word", "own", "at"],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def runs():
            own, at, ids = (np.concatenate(x) for x in held)
            return _runs(ids, np.concatenate([[False], (own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            if size > SLICE_BYTES // 8 and columns[0][0] != held[0][-1][-1]:
                yield _row_of(runs())
                held, size = ([], [], []), 0
            for mine, new in zip(held, columns):
                mine.append(new)
            size += batch.num_rows
        if size:
            yield _row_of(runs())

    own = docs.select("lang", "text").withColumn("own", F.monotonically_increasing_id())
    each = map_batches(own, spread, "lang string, word string, own bigint, at bigint")
    numbered = lookup_join(each, known.select("lang", "word", "id", "f"), ["lang", "word"], weight="f")
    ordered = numbered.select("own", "at", "id").repartition("own").sortWithinPartitions("own", "at")
    return map_batches(ordered, gather, _RUNS).where(F.size("ids") > 0)


def _arrays(batches: Iterator[pa.RecordBatch], least: int = 1 << 19) -> Iterator[np.ndarray]:
    """Runs of several rows at a time."""
    held, size = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column(0)[row].values.to_numpy()
            held += [ids, np.array([-1])]
            size += len(ids)
            if size >= least:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


_KEYED = "key bigint, f bigint"


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    key, f = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(f.astype(np.int64))], ["key", "f"])


def pair_counts(runs: DataFrame, size: int) -> DataFrame:
    """``(key, f)``: how often two words are neighbours; a key is ``first * (size + 1) + second + 1``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _arrays(batches):
            first = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            yield _counted(ids[first] * (size + 1) + ids[first + 1] + 1)

    return map_batches(runs, count, _KEYED).groupBy("key").agg(F.sum("f").alias("f"))


def suffixes(ids: np.ndarray, pairs: BitTable, size: int) -> np.ndarray:
    """All suffixes of three words or more of runs, cut at five words and at rare pairs; -1 behind the end."""
    ids = np.concatenate([ids, np.full(DEPTH, -1)])
    linked = np.zeros(len(ids), bool)
    first = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    linked[first] = pairs.has(ids[first] * (size + 1) + ids[first + 1] + 1)
    at = np.flatnonzero(linked[:-1] & linked[1:])
    out = np.full((len(at), DEPTH), -1, np.int64)
    out[:, 0], going = ids[at], np.ones(len(at), bool)
    for k in range(1, DEPTH):
        going = going & linked[at + k - 1]
        out[going, k] = ids[at[going] + k]
    return out


@dataclass
class Groups:
    """Ranges of prefixes. ``beyond[k]`` holds the prefixes of ``k`` words over the budget, as keys of (number of the prefix
    before among those over the budget, or the first word; last word); ``cuts[k]`` the keys where groups begin."""

    size: int
    beyond: dict[int, np.ndarray] = field(default_factory=dict)
    cuts: dict[int, np.ndarray] = field(default_factory=dict)

    def keys_at(self, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose prefixes are over the budget up to ``depth - 1`` words, and their keys at ``depth``."""
        at, before = np.arange(len(rows)), rows[:, 0]
        for k in range(2, depth):
            over, key = self.beyond.get(k, np.zeros(0, np.int64)), before * (self.size + 1) + rows[at, k - 1] + 1
            if not len(over):
                return at[:0], at[:0]
            place = np.minimum(np.searchsorted(over, key), len(over) - 1)
            hit = over[place] == key
            at, before = at[hit], place[hit]
        return at, before * (self.size + 1) + rows[at, depth - 1] + 1

    def group_of(self, rows: np.ndarray) -> np.ndarray:
        """A number for each suffix; its last three bits are the depth of the prefixes that the group holds whole."""
        out = np.zeros(len(rows), np.int64)
        for depth in range(2, DEPTH + 1):
            at, key = self.keys_at(rows, depth)
            if len(at):
                out[at] = np.searchsorted(self.cuts.get(depth, key[:0]), key, "right") * 8 + depth
        return out


def _cuts(prefixes: DataFrame, budget: int) -> np.ndarray:
    """The keys at which groups begin, in the order of keys."""
    parts = stored(prefixes.select("key", "f").repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("part").agg(F.sum("f").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    running = parts.join(F.broadcast(shifts), "part").withColumn("run", F.coalesce(F.sum("f").over(inside), F.lit(0)) + F.col("shift"))
    begins = running.groupBy(F.floor(F.col("run") / budget).alias("group")).agg(F.min("key").alias("key"))
    keys = np.sort(np.array([r.key for r in begins.select("key").collect()], np.int64))
    release(parts)
    return keys


def _over(prefixes: DataFrame, budget: int) -> list:
    return sorted((r.key, r.f) for r in prefixes.where(F.col("f") > budget).select("key", "f").collect())


def partition(runs: DataFrame, pairs: DataFrame, table: BitTable, size: int, budget: int) -> tuple[Groups, list]:
    """Groups by the budget, and ``(words, f)`` of the prefixes of three words or more beyond it."""
    groups, known, prefixes, names = Groups(size), [], pairs, {}
    for depth in range(2, DEPTH + 1):
        groups.cuts[depth] = _cuts(prefixes, budget)
        over = _over(prefixes, budget) if depth < DEPTH else []
        if depth > 2:
            release(prefixes)
        if not over:
            break
        groups.beyond[depth] = np.array([key for key, _ in over], np.int64)
        before, names = names, {}
        for place, (key, f) in enumerate(over):
            head, last = divmod(key, size + 1)
            names[place] = (*(before[head] if depth > 2 else (head,)), last - 1)
            if depth > 2:
                known.append((list(names[place]), f))

        def count(batches, depth=depth + 1):
            for ids in _arrays(batches):
                rows = suffixes(ids, table_.value, size)
                at, key = groups_.value.keys_at(rows, depth)
                ends = rows[at, depth - 1] >= 0
                if ends.any():
                    yield _counted(key[ends])

        context = runs.sparkSession.sparkContext
        table_, groups_ = context.broadcast(table), context.broadcast(groups)
        prefixes = stored(map_batches(runs, count, _KEYED).groupBy("key").agg(F.sum("f").alias("f")))
    return groups, known


_WORDS = [f"w{k}" for k in range(1, DEPTH + 1)]


def leaves(runs: DataFrame, table: BitTable, groups: Groups) -> DataFrame:
    """``(group, w1..w5, f)``: truncated suffixes, added up batch by batch."""
    context = runs.sparkSession.sparkContext
    table_, groups_ = context.broadcast(table), context.broadcast(groups)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groups_.value
        for ids in _arrays(batches):
            rows = suffixes(ids, table_.value, groups.size)
            rows = rows[np.lexsort(rows.T[::-1])]
            if not len(rows):
                continue
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            first = np.flatnonzero(new)
            f = np.diff(np.append(first, len(rows)))
            rows = rows[first]
            yield pa.RecordBatch.from_arrays([pa.array(groups.group_of(rows)), *(pa.array(c) for c in rows.T), pa.array(f)], ["group", *_WORDS, "f"])

    return map_batches(runs, cut, "group bigint, " + ", ".join(f"{w} bigint" for w in _WORDS) + ", f bigint")


def subtree_counts(rows: np.ndarray, f: np.ndarray, depth: int, support: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of the subtree over sorted leaves: ``(words, count)`` for each depth from ``depth`` on."""
    differs = rows[1:] != rows[:-1]
    for k in range(depth, DEPTH + 1):
        first = np.flatnonzero(np.concatenate([[True], differs[:, :k].any(axis=1)]))
        total = np.add.reduceat(f, first)
        keep = (rows[first, k - 1] >= 0) & (total >= support)
        if keep.any():
            yield rows[first[keep], :k], total[keep]


def _subtrees(leaf: DataFrame, support: int) -> DataFrame:
    ordered = leaf.repartition("group").sortWithinPartitions("group", *_WORDS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_by(batches, "group"):
            rows = np.stack([group.column(w).to_numpy() for w in _WORDS], axis=1)
            depth = max(3, int(group.column("group")[0].as_py()) & 7)
            for node, total in subtree_counts(rows, group.column("f").to_numpy(), depth, support):
                yield pa.RecordBatch.from_arrays([pa.array(node.tolist(), pa.list_(pa.int64())), pa.array(total)], ["p", "f"])

    return map_batches(ordered, build, "p array<bigint>, f bigint")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, budget: int = BUDGET, dictionary_bytes: int = DICTIONARY_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(p, f)`` of all frequent phrases of one to five words, the words ``(id, lang, word, f)`` and ``(lang, n)``."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs).where((F.col("f") >= support) | F.col("word").isNull()))
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    known = stored(with_rank(counts.where("word is not null"), [F.col("lang"), F.col("word")], "id"))
    bound = known.agg(F.count("*").alias("size"), F.sum(F.octet_length("word") + F.octet_length("lang") + 64).alias("bytes")).first()
    size = bound["size"]
    if size >= 3_000_000_000:
        raise ValueError("keys of two words need fewer than three billion frequent words")
    runs = stored((runs_by_broadcast if (bound["bytes"] or 0) <= dictionary_bytes else runs_by_join)(docs, known))
    pairs = stored(pair_counts(runs, size).where(F.col("f") >= support))
    table = BitTable.of(pairs, pairs.count())
    groups, over = partition(runs, pairs, table, size, budget)
    deep = stored(_subtrees(leaves(runs, table, groups), support))
    two = pairs.select(F.expr(f"array(key div {size + 1}, key % {size + 1} - 1)").alias("p"), "f")
    all_ = known.select(F.array("id").alias("p"), "f").unionByName(two).unionByName(deep)
    over = [(p, f) for p, f in over if f >= support]
    if over:
        all_ = all_.unionByName(spark.createDataFrame(over, "p array<bigint>, f bigint"))
    phrases = stored(all_)
    release(runs, pairs, deep)
    return phrases, known, totals


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, budget: int = BUDGET, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``docs`` need ``text`` and ``lang``; ``(lang, rank, phrase, a, l, r, n, score)``, the ``top`` phrases of each language."""
    phrases, known, totals = frequent_phrases(docs, support, budget, dictionary_bytes)
    candidates = phrases.where(F.size("p") >= 2).withColumnRenamed("f", "a")
    inside = candidates.where(F.size("p") >= 3).select(
        F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), F.col("a").alias("longer")
    )
    covered = inside.groupBy("p").agg(F.max("longer").alias("longer"))
    alone = candidates.join(covered, "p", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    # a phrase begins or ends at most f / support frequent ones
    parts = phrases.withColumn("_n", F.ceil(F.col("f") / support))
    cuts = alone.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(p, 1, k)")).withColumn("right", F.expr("slice(p, k + 1, size(p) - k)"))
    cuts = lookup_join(cuts, parts.select(F.col("p").alias("left"), F.col("f").alias("l"), "_n"), "left", weight="_n")
    cuts = lookup_join(cuts, parts.select(F.col("p").alias("right"), F.col("f").alias("r"), "_n"), "right", weight="_n")
    languages = lookup_join(known.select("id", "lang", "f"), totals.withColumn("_n", F.col("n")), "lang", weight="_n")
    cuts = lookup_join(cuts.withColumn("id", F.col("p")[0]), languages, "id", weight="f")
    wide = {c: f"cast({c} as decimal(38, 0))" for c in "alrn"}
    scored = cuts.withColumn("score", F.expr(f"(cast(1000 as decimal(38, 0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})"))
    best = scored.groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("p", "lang", "a", "cut.l", "cut.r", "n", "cut.score")
    falling = [F.desc("score"), F.desc("a")]
    near = stored(best.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(*falling))).where(F.col("_place") <= top))
    spelled = lookup_join(near.select("p", F.posexplode("p").alias("at", "id")), known.select("id", "word", "f"), "id", weight="f")
    texts = spelled.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(*falling, "phrase")
    ranked = near.join(texts, "p").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
