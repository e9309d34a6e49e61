"""Document fingerprints by a randomised edit embedding.

Shared random walks read a text: at every step a random bit, fixed by the step and the character under
the pointer, says whether the pointer moves on. The characters read step by step are the embedded text;
few edits change few of its places, because two walks that were set apart meet again. A character that does not
move the pointer holds it for the rest of ``HOLD`` steps, which lets walks that are a sentence apart drift together
sooner than single steps would. Each walk runs over the whole text, however long; those of a batch advance together
in numpy, longest first, and the few longest go on alone. There are ``WALKS`` of them, since a walk may fail to
meet: a sentence in front of a text leaves it alike in four of ten cases at 2,000 characters, in most from 6,000 on.

The fingerprint samples the embedded texts at ``SLOTS`` steps in all, one byte each. Each slot has an endless
random sequence of record steps and takes the last one inside the text: uniform over the whole text
whatever its length, and the same step for most pairs of similar length. Likeness is the largest share of equal
slots of a walk, an estimate of one minus the Hamming distance of the embedded texts.

Near texts are found by banding: ``BANDS`` groups of sampled slots are keys, and all different fingerprints of a
bucket are compared whole. A bucket is dealt into blocks of about ``BLOCK_PRINTS`` and every pair of blocks is a
task's work, in order of documents; a fingerprint is done at the first one it is like. Only buckets whose texts
share a band but are not alike cost the square of their different fingerprints.

Defined cases: null counts as empty; the empty text has a fingerprint of its own; documents with equal
ids are ordered by a hash of their text; null ids come last; a single document is its own next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import grouped_by, map_batches, sha256, stored, texts_of
from logweave.llm.hashing import mix, odd_numbers

SLOTS = 64
WALKS = 2
HOLD = 32  # steps of a hold at most
BANDS = 16
ALIKE = 0.7
BLOCK_PRINTS = 1024
_CANDIDATES = 64
_PERIOD = 4096
_CHARS = 1 << 22  # characters embedded at once
_FEW = 16  # walks that numpy advances no faster than plain Python
_SPAN = 1 << 40  # more than the steps of any text


def _walk_table(walk: int) -> np.ndarray:
    """Steps spent on a character of class ``c`` that is reached at step ``t`` (modulo the period), two on average."""
    cells = np.arange(256 * (_PERIOD // HOLD), dtype=np.uint64) + np.uint64(walk << 32)
    held = mix(cells).reshape(256, -1) < np.uint64((1 << 64) // (HOLD // 2))
    moves = np.repeat(~held, HOLD, axis=1)
    twice = np.concatenate([moves, moves], axis=1)
    steps = np.zeros(twice.shape, np.int32)
    ahead = np.zeros(256, np.int32)
    for t in range(2 * _PERIOD - 1, -1, -1):
        ahead = np.where(twice[:, t], 1, ahead + 1)
        steps[:, t] = ahead
    return np.ascontiguousarray(steps[:, :_PERIOD]).ravel()


def _records() -> list[np.ndarray]:
    """Per slot the steps at which a sequence of independent random numbers has a new minimum."""
    out = []
    for slot in range(SLOTS):
        rng = np.random.default_rng(1000 + slot)
        at, found = 0, []
        while at < 1 << 60:
            found.append(at)
            at = int(at / (1 - rng.random())) + 1
        out.append(np.array(found, np.int64))
    return out


_tables: dict = {}


def _fixed() -> tuple[list[np.ndarray], list[list[int]], list[np.ndarray], np.ndarray]:
    if not _tables:
        steps = [_walk_table(walk) for walk in range(WALKS)]
        _tables["all"] = (steps, [x.tolist() for x in steps], _records(), odd_numbers(SLOTS, 5))
    return _tables["all"]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``SLOTS`` bytes per text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _CHARS or i == len(texts) - 1:
            out[first : i + 1] = _embed(texts[first : i + 1])
            first, size = i + 1, 0
    return out


def _walked(classes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, steps: np.ndarray, plain: list[int]) -> np.ndarray:
    """The step at which the walk of its text reaches each character; texts are given longest first."""
    reached = np.empty(len(classes), np.int64)
    now = np.zeros(len(begins), np.int64)
    i, n = 0, len(begins)
    while n > _FEW:
        end, walks, first = int(lengths[n - 1]), now[:n], begins[:n]
        for i in range(i, end):
            at = first + i
            reached[at] = walks
            walks += steps[classes[at] + (walks & (_PERIOD - 1))]
        i, n = end, n - 1
    for k in range(n):
        step, passed = int(now[k]), []
        for c in classes[begins[k] + i : begins[k] + lengths[k]].tolist():
            passed.append(step)
            step += plain[c + (step & (_PERIOD - 1))]
        reached[begins[k] + i : begins[k] + lengths[k]] = passed
    return reached


def _embed(texts: list[str]) -> np.ndarray:
    steps, plain, records, odd = _fixed()
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((len(texts), SLOTS), np.uint8)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    order = filled[np.argsort(-sizes[filled], kind="stable")]
    classes = ((chars ^ (chars >> np.uint32(8))) & np.uint32(255)).astype(np.int64) * _PERIOD
    gram = _grams(chars, (begin + sizes)[filled])
    # one rising key over all texts, so that one search finds the character under any sampled step
    apart = np.repeat(np.arange(len(texts), dtype=np.int64) * _SPAN, sizes)
    for slot in range(SLOTS):
        walk, first = divmod(slot, SLOTS // WALKS)
        if not first:
            reached = _walked(classes, begin[order], sizes[order], steps[walk], plain[walk])
            reached += apart
        record = records[slot]
        step = record[np.searchsorted(record, 2 * sizes[filled], "left") - 1]
        place = np.searchsorted(reached, filled * _SPAN + step, "right") - 1
        value = gram[place] * odd[slot] + step.astype(np.uint64)
        out[filled, slot] = (mix(value) >> np.uint64(56)).astype(np.uint8)
    return out


def _grams(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each character and the two behind it, as far as its text goes."""
    wide = np.concatenate([chars, np.zeros(2, chars.dtype)]).astype(np.uint64)
    second, third = wide[1:-1].copy(), wide[2:].copy()
    second[ends - 1] = third[ends - 1] = 0
    third[np.maximum(ends - 2, 0)] = 0
    return wide[:-2] | second << np.uint64(21) | third << np.uint64(42)


def as_text(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).reshape(-1, WALKS, SLOTS // WALKS).mean(axis=2).max(axis=1, initial=0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_RESULT_DDL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(texts: list[str], prints: np.ndarray, changed: list[str], changed_prints: np.ndarray, next_prints: np.ndarray) -> list[pa.Array]:
    columns = [
        [len(t) for t in texts], [sha256(t) for t in changed], as_text(prints), as_text(changed_prints),
        likeness(prints, changed_prints), likeness(prints, next_prints),
    ]
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _RESULT)]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they and the next document's are.

    One shuffle deals the texts out by ranges of descending id; a task reads its range in order. The last
    row of a range meets the first row of the next range in a small join of one row per range.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    ranges = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["part", "kind", "doc_id", "text", *(n for n, _ in _RESULT)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_id = last_text = last_print = None

        def rows(ids: pa.Array, kind: str, texts: list[str | None], result: list[pa.Array] | None) -> pa.RecordBatch:
            n = len(ids)
            arrays = result or [pa.nulls(n, k) for _, k in _RESULT]
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([kind] * n), ids, pa.array(texts, pa.string()), *arrays], names
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), texts_of(batch.column(1))
            held_ids, held = (ids, texts) if last_id is None else (pa.concat_arrays([last_id, ids]), [*last_text, *texts])
            changed = [edited(a, b) for a, b in zip(held, held[1:])]
            prints = fingerprints(texts + changed)  # walks of all advance together
            prints, changed_prints = prints[: len(texts)], prints[len(texts) :]
            if last_id is None:
                yield rows(ids[:1], "head", texts[:1], None)
                held_prints = prints
            else:
                held_prints = np.concatenate([last_print, prints])
            if len(held) > 1:
                yield rows(held_ids[:-1], "row", [None] * (len(held) - 1), _compare(held[:-1], held_prints[:-1], changed, changed_prints, held_prints[1:]))
            last_id, last_text, last_print = held_ids[-1:], held[-1:], held_prints[-1:]
        if last_id is not None:
            yield rows(last_id, "tail", last_text, None)

    done = stored(map_batches(ranges, read, f"part int, kind string, doc_id {id_type}, text string, {_RESULT_DDL}"))
    parts = sorted(r["part"] for r in done.where("kind = 'head'").select("part").collect())  # one number per range
    follows = done.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])) or [], "part int, next_part int")
    heads = done.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = done.where("kind = 'tail'").select("part", "doc_id", "text").join(follows, "part").join(heads, "next_part")

    def close(batches):
        for batch in batches:
            texts, following = texts_of(batch.column(1)), texts_of(batch.column(2))
            changed = [edited(a, b) for a, b in zip(texts, following)]
            result = _compare(texts, fingerprints(texts), changed, fingerprints(changed), fingerprints(following))
            yield pa.RecordBatch.from_arrays([batch.column(0), *result], ["doc_id", *(n for n, _ in _RESULT)])

    closed = map_batches(tails.select("doc_id", "text", "next_text"), close, f"doc_id {id_type}, {_RESULT_DDL}")
    return done.where("kind = 'row'").select("doc_id", *(n for n, _ in _RESULT)).unionByName(closed)


def smallest_alike(prints: np.ndarray, alike: float = ALIKE) -> np.ndarray:
    """Per row the first earlier row it is like, or -1; all pairs are compared until a row has found one."""
    out = np.full(len(prints), -1)
    for first in range(0, len(prints), _CANDIDATES):
        last = min(first + _CANDIDATES, len(prints))
        rows = first + np.flatnonzero(out[first:] < 0)
        equal = (prints[rows, None] == prints[None, first:last]).reshape(len(rows), last - first, WALKS, SLOTS // WALKS)
        equal = (equal.sum(axis=3, dtype=np.uint8) >= alike * (SLOTS // WALKS)).any(axis=2)
        equal &= np.arange(first, last) < rows[:, None]
        found = equal.any(axis=1)
        out[rows[found]] = first + equal[found].argmax(axis=1)
    return out


def link_near(prints: DataFrame, alike: float = ALIKE, block: int = BLOCK_PRINTS) -> DataFrame:
    """``(doc_id, fingerprint)`` to ``(fingerprint, near_id)``: the smallest of all documents that share a bucket and are verified alike."""
    id_type = prints.schema["doc_id"].dataType.simpleString()
    once = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    once = stored(once.withColumn("print", F.xxhash64("fingerprint")))
    wide = 2 * SLOTS // BANDS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("fingerprint", b * wide + 1, wide)) for b in range(BANDS)])
    keyed = once.select("print", F.explode(bands).alias("key"))
    shared = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    # every row of a bucket of several blocks goes to all pairs of its block with another one, which hold its own block too
    blocks = shared.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.expr("if(blocks = 1, array(0), filter(sequence(0, blocks - 1), i -> i <> own))")))
    blocks = blocks.select("print", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("pair"))
    # the fingerprints themselves follow only to rows that share a bucket
    rows = blocks.join(once.select("print", "doc_id", F.unhex("fingerprint").alias("bytes")), "print")
    order = ["pair", F.asc_nulls_last("doc_id"), "print"]
    rows = rows.select("pair", "print", "doc_id", "bytes").repartition("pair").sortWithinPartitions(*order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_by(batches, "pair"):
            bytes_of = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8).reshape(-1, SLOTS)
            found = smallest_alike(bytes_of, alike)
            linked = np.flatnonzero(found >= 0)
            if len(linked):
                names, ids = group.column("print").combine_chunks(), group.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(linked)), ids.take(pa.array(found[linked]))], ["print", "near_id"])

    best = map_batches(rows, read, f"print bigint, near_id {id_type}").groupBy("print").agg(F.min("near_id").alias("found"))
    return once.join(best, "print", "left").select("fingerprint", F.least("doc_id", "found").alias("near_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``compare_with_next`` with ``near_id`` of ``link_near`` (null where all ids of the text are)."""
    found = stored(compare_with_next(docs))
    return found.join(link_near(found.select("doc_id", "fingerprint")), "fingerprint", "left")
