"""Removal of repeated passages by suffix automata over shards of reference text.

A window is ``LENGTH`` consecutive words of a document. A word goes when a window over it has the word
sequence of an earlier window (smaller id, or same document and earlier start), judged on the input.

1. *Anchors.* Of every window the smallest hash of its ``GRAM``-word runs is taken (winnowing), about one run in
   eight. Equal windows have equal anchors, so only windows whose anchor another document has, or that
   their own document holds twice, can repeat.
2. *Regions.* Those windows are hashed, and of every window hash the first place is found by aggregation. Consecutive windows
   of the same anchor form a run; where all runs of an anchor are the same, the run is hashed and shuffled as one
   piece for its windows, about eight times fewer rows. Consecutive windows that are first places form reference passages, all others passages to be judged.
3. *Automata.* Reference passages are dealt into shards of about ``SHARD_WORDS`` words by their document. A task
   builds the suffix automaton of a shard from its words and streams the passages whose first place
   lies there: a matching statistic of ``LENGTH`` or more covers that many words, which are removed. The
   automaton compares words, so a collision of hashes can never remove text.

The reference grows with the corpus, so that an automaton of all of it has no bound that would allow a
broadcast. Each shard goes only to the tasks that need it; a shard whose passages exceed ``LOAD_WORDS`` words is
copied to several tasks, so that a passage in a third of all documents is spread. Only the text of regions is
shuffled, all other exchanges carry hashes and places; a hot anchor or window is aggregated before the shuffle, and
the joins back are split by adaptive execution. Repeated anchors reach the scan of the texts as a bit table of at most
64 MB; what it takes for repeated by mistake is sorted out with the hashes of whole windows.

Defined cases: null and empty texts have no words; null ids come last; rows of equal id are told apart by a
hash of their text, rows equal in both are one document; other columns of the input stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.bits import ROOM, BitTable
from logweave.llm.common import map_batches, put_back, release, set_aside, sha256, slices, stored, texts_of, utf8
from logweave.llm.hashing import inside_row, mix, runs, words

LENGTH = 20
GRAM = 6
SHARD_WORDS = 100_000
LOAD_WORDS = 1_000_000
_KEY = ["_id", "_tie"]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def window_anchors(hashes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The word places where a window of one row begins, and the anchor hash of each."""
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = inside_row(first, length)
    smallest = _sliding(runs(hashes, gram, 3), length - gram + 1, np.minimum)
    return starts, smallest[starts]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id`` (nulls last) and ``_tie``, which is zero unless ids repeat."""
    n, distinct = docs.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("doc_id"), F.lit(1 << 62)))).first()
    tie = F.lit(0).cast("long") if n == distinct else F.xxhash64("text")
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_tie", tie)


def _anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """``(_id, _tie, hash)``: the different anchors of a document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (np.asarray(batch.column(i)) for i in (0, 1))
            data, places = utf8(batch.column(2))
            for low, high in slices(places):
                found = words(data[places[low] : places[high]], places[low : high + 1] - places[low])
                starts, anchors = window_anchors(found.hashes, found.first, length, gram)
                row = np.searchsorted(found.first, starts, "right") - 1
                order = np.lexsort((anchors, row))
                row, anchors = row[order], anchors[order]
                at = np.ones(len(row), bool)
                at[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low + row[at]]), pa.array(ties[low + row[at]]), pa.array(anchors[at].view(np.int64))], [*_KEY, "hash"]
                )

    return map_batches(keyed.select(*_KEY, "text"), read, "_id bigint, _tie bigint, hash bigint")


def _regions(keyed: DataFrame, length: int, gram: int, room: int) -> DataFrame:
    """``(_id, _tie, start, text)``: the stretches of a document covered by windows that may repeat.

    Up to ``room`` anchors that several documents have are shipped to the scan as a bit table. Beyond, each document is joined
    with its own.
    """
    anchors = _anchors(keyed, length, gram)
    often = stored(anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("key")))
    count = often.count()
    texts, shared = keyed.select(*_KEY, "text"), None
    if count <= room:
        shared = keyed.sparkSession.sparkContext.broadcast(BitTable.of(often, count))
        regions = map_batches(texts, _stretches(length, gram, lambda anchors, _: shared.value.has(anchors)), _REGION)
    else:
        own = anchors.join(often.withColumnRenamed("key", "hash"), "hash").groupBy(*_KEY).agg(F.collect_list("hash").alias("hashes"))
        regions = map_batches(texts.join(own, _KEY, "left"), _stretches(length, gram, _is_own), _REGION)
    regions = stored(regions, "zstd")
    if shared is not None:
        shared.unpersist()
    release(often)
    return regions


_REGION = "_id bigint, _tie bigint, start int, text string"


def _is_own(anchors: np.ndarray, hashes: pa.Scalar) -> np.ndarray:
    return np.isin(anchors, np.asarray(hashes.values if hashes.is_valid else [], np.int64).view(np.uint64))


def _stretches(length: int, gram: int, may_repeat):
    """Cut out what windows cover whose anchor may repeat, or that their own document holds twice."""

    def read(batches):
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1)
            known = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
            data, places = utf8(batch.column(2))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                own = data[places[i] : places[i + 1]]
                found = words(own, np.array([0, len(own)]))
                starts, anchors = window_anchors(found.hashes, found.first, length, gram)
                at = starts[may_repeat(anchors, known[i]) | _twice(found.hashes, starts, length)]
                if len(at):
                    cut = np.flatnonzero(np.diff(at) > length)
                    for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + length):
                        text = own[found.starts[a] : found.ends[b - 1]].tobytes().decode("utf-8", "surrogatepass")
                        out.append((ids[i].as_py(), ties[i].as_py(), int(a), text))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_KEY, "start", "text"])

    return read


def _twice(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Windows whose content the document itself holds twice or more."""
    full = runs(hashes, length, 4)[starts]
    _, where, n = np.unique(full, return_inverse=True, return_counts=True)
    return n[where] > 1


def _split(batch: pa.RecordBatch, length: int, gram: int):
    """For some regions of the batch at a time: row and place of their windows, hash, anchor, and the run each belongs to.

    A run is a stretch of consecutive windows of a region that have the same anchor.
    """
    begin = np.asarray(batch.column(2))
    data, places = utf8(batch.column(3))
    for low, high in slices(places):
        found = words(data[places[low] : places[high]], places[low : high + 1] - places[low])
        starts, anchors = window_anchors(found.hashes, found.first, length, gram)
        if not len(starts):
            continue
        row = np.searchsorted(found.first, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (np.diff(starts) > 1) | (np.diff(row) > 0)
        yield low + row, begin[low + row] + (starts - found.first[row]), runs(found.hashes, length, 4)[starts], anchors, new


def _run_hashes(windows: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run begins, its number of windows, and a hash of its windows in their order."""
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(new)))
    nth = (np.arange(len(new)) - np.repeat(first, sizes)).astype(np.uint64)
    return first, sizes, mix(np.add.reduceat(mix(windows ^ mix(nth + np.uint64(1))), first) + sizes.astype(np.uint64))


def _ambiguous(regions: DataFrame, length: int, gram: int) -> DataFrame:
    """``key``: anchors whose runs are not all the same, or that have a window twice in one run."""

    def read(batches):
        for batch in batches:
            for _, _, windows, anchors, new in _split(batch, length, gram):
                first, _, hashes = _run_hashes(windows, new)
                run = np.cumsum(new) - 1
                order = np.lexsort((windows, run))
                same = (windows[order][1:] == windows[order][:-1]) & (run[order][1:] == run[order][:-1])
                twice = np.unique(run[order][1:][same])
                keys = np.append(anchors[first], anchors[first][twice])
                hashes = np.append(hashes, ~hashes[twice])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hashes.view(np.int64))], ["key", "run"])

    found = map_batches(regions, read, "key bigint, run bigint").groupBy("key").agg(F.min("run").alias("least"), F.max("run").alias("most"))
    return found.where("least < most").select("key")


def _pieces(regions: DataFrame, length: int, gram: int, ambiguous) -> DataFrame:
    """``(piece, _id, _tie, pos, size)``: the windows of the regions, those of a run as one piece unless its anchor is ambiguous.

    Equal windows have equal anchors. If all runs of an anchor are the same and hold no window twice, equal windows lie at the same place
    of equal runs, so the first place of a run is that of its windows. ``ambiguous`` is a bit table; an anchor
    it names by mistake has its windows one by one, in all documents alike.
    """

    def read(batches):
        for batch in batches:
            ids, ties = (np.asarray(batch.column(i)) for i in (0, 1))
            for row, pos, windows, anchors, new in _split(batch, length, gram):
                alone = ambiguous.value.has(anchors)
                first, sizes, hashes = _run_hashes(windows, new)
                whole = ~alone[first]
                at = np.append(first[whole], np.flatnonzero(alone))
                piece = np.append(hashes[whole], windows[alone])
                size = np.append(sizes[whole], np.ones(len(at) - int(whole.sum()), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(piece.view(np.int64)), pa.array(ids[row[at]]), pa.array(ties[row[at]]),
                        pa.array(pos[at].astype(np.int32)), pa.array(size.astype(np.int32)),
                    ],
                    ["piece", *_KEY, "pos", "size"],
                )

    return map_batches(regions, read, "piece bigint, _id bigint, _tie bigint, pos int, size int")


def _passages(pieces: DataFrame, firsts: DataFrame, shards: int, length: int) -> DataFrame:
    """``(_id, _tie, reference, shard, start, end)``: runs of windows that are first places, or have theirs in one shard."""
    own = (F.col("_id") == F.col("first._id")) & (F.col("_tie") == F.col("first._tie")) & (F.col("pos") == F.col("first.pos"))
    shard = F.pmod(F.xxhash64("first._id", "first._tie"), F.lit(shards)).cast("int")
    judged = pieces.join(firsts, "piece").select(*_KEY, "pos", "size", own.alias("reference"), shard.alias("shard"))
    ordered = judged.repartition(*_KEY).sortWithinPartitions(*_KEY, "reference", "shard", "pos")

    def read(batches):
        for batch in batches:
            ids, ties, pos, size = (np.asarray(batch.column(i)) for i in range(4))
            ref, shard = batch.column(4).to_numpy(zero_copy_only=False), np.asarray(batch.column(5))
            if not len(ids):
                continue
            new = np.ones(len(ids), bool)
            new[1:] = (pos[1:] > pos[:-1] + size[:-1]) | (np.diff(pos) < 0)
            for values in (ids, ties, ref, shard):
                new[1:] |= values[1:] != values[:-1]
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(ids)) - 1
            end = (pos[b] + size[b] - 1 + length).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a]), pa.array(ties[a]), pa.array(ref[a]), pa.array(shard[a]), pa.array(pos[a]), pa.array(end)],
                [*_KEY, "reference", "shard", "start", "end"],
            )

    return map_batches(ordered, read, "_id bigint, _tie bigint, reference boolean, shard int, start int, end int")


def _with_words(passages: DataFrame, regions: DataFrame) -> DataFrame:
    """The passages with their text, cut from the regions of their document."""
    cuts = passages.groupBy(*_KEY).agg(F.collect_list(F.struct("reference", "shard", "start", "end")).alias("cuts"))
    texts = regions.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("regions"))

    def read(batches):
        for batch in batches:
            out: list[tuple] = []
            for id_, tie, cuts, regions in zip(*(c.to_pylist() for c in batch.columns)):
                starts = np.array([r["start"] for r in regions])
                split: dict[int, list[str]] = {}
                for c in cuts:
                    k = int(np.searchsorted(starts, c["start"], "right")) - 1
                    if k not in split:
                        split[k] = _WORD.findall(regions[k]["text"])
                    begin = c["start"] - int(starts[k])
                    text = " ".join(split[k][begin : begin + c["end"] - c["start"]])
                    out.append((id_, tie, c["reference"], c["shard"], c["start"], c["end"], text))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_KEY, "reference", "shard", "start", "end", "text"])

    schema = "_id bigint, _tie bigint, reference boolean, shard int, start int, end int, text string"
    return map_batches(cuts.join(texts, _KEY), read, schema)


class SuffixAutomaton:
    """All word sequences of the passages added; passages are kept apart by a sign of their own."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self.passages = 0

    def add(self, passage: list[str]) -> None:
        self.passages += 1
        for word in passage:
            self._extend(word)
        self._extend(self.passages)  # a number equals no word

    def _extend(self, word) -> None:
        following, link, length = self.next, self.link, self.length
        new = len(following)
        following.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        at = self.last
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at >= 0:
            other = following[at][word]
            if length[other] == length[at] + 1:
                link[new] = other
            else:
                copy = len(following)
                following.append(dict(following[other]))
                length.append(length[at] + 1)
                link.append(link[other])
                while at >= 0 and following[at].get(word) == other:
                    following[at][word] = copy
                    at = link[at]
                link[other] = link[new] = copy
        self.last = new

    def covered(self, passage: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal stretches of ``passage`` made of matches of ``least`` words or more, from the matching statistics."""
        following, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = matched = 0
        for end, word in enumerate(passage, 1):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            if matched >= least:
                if out and end - least <= out[-1][1]:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((end - least, end))
        return out


def _matched(passages: DataFrame, length: int, load_words: int) -> DataFrame:
    """``(_id, _tie, start, end)``: words of the passages that the automaton of their shard covers."""
    size = F.col("end") - F.col("start")
    copies = F.ceil(F.sum(F.when(~F.col("reference"), size).otherwise(0)) / load_words)
    loads = passages.groupBy("shard").agg(F.greatest(copies, F.lit(1)).cast("int").alias("copies"))
    mine = F.pmod(F.xxhash64(*_KEY, "start"), F.col("copies")).cast("int")
    every = F.sequence(F.lit(0), F.col("copies") - 1)
    dealt = passages.join(loads, "shard").withColumn("copy", F.explode(F.when(F.col("reference"), every).otherwise(F.array(mine))))
    dealt = dealt.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.desc("reference"))

    def read(batches):
        at, automaton = None, SuffixAutomaton()
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(n).to_pylist() for n in ("shard", "copy", "reference", *_KEY, "start", "text"))
            for shard, copy, reference, id_, tie, start, text in zip(*columns):
                if at != (shard, copy):
                    at, automaton = (shard, copy), SuffixAutomaton()
                if reference:
                    automaton.add(text.split(" "))
                else:
                    out += [(id_, tie, start + a, start + b) for a, b in automaton.covered(text.split(" "), length)]
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_KEY, "start", "end"])

    return map_batches(dealt, read, "_id bigint, _tie bigint, start int, end int")


def find_repeats(docs: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS, load_words: int = LOAD_WORDS, room: int = ROOM) -> DataFrame:
    """``docs`` with ``repeats array<struct<start, end>>``: word ranges to remove, sorted, apart; a column of that name is replaced."""
    names = [c for c in docs.columns if c != "repeats"]
    docs, taken = set_aside(docs.drop("repeats"), *_KEY)
    gram = min(GRAM, length)
    keyed = _keyed(docs)
    regions = _regions(keyed, length, gram, room)
    ambiguous = stored(_ambiguous(regions, length, gram))
    table = docs.sparkSession.sparkContext.broadcast(BitTable.of(ambiguous, ambiguous.count()))
    release(ambiguous)
    pieces = _pieces(regions, length, gram, table)
    place = F.struct(*_KEY, "pos")
    firsts = pieces.groupBy("piece").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("size").alias("size"))
    firsts = stored(firsts.where("n > 1").select("piece", "first", F.col("size").alias("windows")), "zstd")
    shards = -(-(firsts.agg(F.sum("windows")).first()[0] or 0) // shard_words) or 1
    passages = stored(_passages(pieces, firsts.drop("windows"), shards, length), "zstd")
    table.unpersist()
    release(firsts)
    texts = stored(_with_words(passages, regions), "zstd")
    release(passages, regions)
    matched = _matched(texts, length, load_words).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("repeats"))
    matched = stored(matched)
    release(texts)
    return put_back(keyed.join(matched, _KEY, "left").drop(*_KEY), taken).select(*names, "repeats")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def repeat_digest(found: DataFrame) -> DataFrame:
    """Per document its words, how many go, and a hash of those kept, joined by one space."""

    def read(batches):
        for batch in batches:
            total, removed, digest = [], [], []
            for text, spans in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                own = _WORD.findall(text)
                gone = _merged(spans)
                total.append(len(own))
                removed.append(sum(e - s for s, e in gone))
                for s, e in reversed(gone):
                    del own[s:e]
                digest.append(sha256(" ".join(own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    return map_batches(found.select("doc_id", "text", "repeats"), read, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; the white space of what stays is unchanged."""
    columns = docs.columns
    docs, taken = set_aside(docs, "repeats")
    found = find_repeats(docs, length)
    at = columns.index("text")

    def read(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    own = [m.span() for m in _WORD.finditer(texts[i])]
                    out, seen = [], 0
                    for s, e in _merged(spans):
                        out.append(texts[i][seen : own[s][0]])
                        seen = own[e][0] if e < len(own) else len(texts[i])
                    texts[i] = "".join(out) + texts[i][seen:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1]
            )

    return put_back(map_batches(found, read, docs.schema), taken).select(*columns)
