"""Packing by lexical retrieval: BM25 neighbours of a seed document fill its window.

Documents are dealt into shards of about ``SHARD_CHARS`` characters by a hash, so that no source and no group
of copies fills one. The task of a shard builds an inverted index of its documents over their token ids. The
document at the head of a window is the seed; unused documents are appended in the order of their BM25
score against it until the window is full. A document that does not end with its window goes on at the
head of the next one and is its seed. Only the last window of a shard can be short; it is cut into
sequences whose lengths are powers of two, so that nothing is padded.

Shards are bounded by their size (and the longest document), whatever the size of the corpus. A token is moved
once, as two bytes where the vocabulary allows.

Defined cases: null and empty texts are the end token alone; repeated rows and null ids are packed like any
other row; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import grouped_by, map_batches, texts_of

WINDOW = 2048
END = 1
SHARD_CHARS = 4_000_000
#: Words whose ids a worker keeps from batch to batch and task to task; about 200 bytes each.
KEPT_WORDS = 1_000_000
#: Words of a call.
TOGETHER = 256
K1, B = 1.2, 0.75


class WordTokenizer:
    """Token ids by the ``tokenizers`` library, for each new word once.

    White space separates tokens of this tokenizer, so ids of a text are those of its words in order. The ids
    of ``kept`` words are kept for later batches; a batch with other words asks for them anew. Special tokens
    written out in a text are split like any word, or have their own ids as in the library's plain call.

    A call costs more than a word. Where the vocabulary marks the ends of words, and letters are split from what follows
    them and lowered, new words of ASCII letters are joined to calls of ``TOGETHER`` words; the ids of each end at a mark.
    """

    def __init__(self, definition: str, kept: int = KEPT_WORDS, split_special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = split_special
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.ends = self._ends(json.loads(definition).get("model", {}))

    def _ends(self, model: dict) -> np.ndarray | None:
        """Whether an id ends a word; none where words cannot be told apart by it."""
        suffix = model.get("end_of_word_suffix")
        parts = [self._plain([x])[0] for x in ("Word", "word", "word.", "word,", "word Word", ".", ",")]
        if not suffix or parts[2:5] != [parts[1] + parts[5], parts[1] + parts[6], 2 * parts[1]] or parts[0] != parts[1]:
            return None
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith(suffix)
        return ends

    def _plain(self, words: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The same for lower-case words of ASCII letters, many to a call."""
        joined = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        raw = b"".join(self._plain(joined))
        ids = np.frombuffer(raw, np.uint16 if self.code == "H" else np.uint32)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) != len(words):
            return self._plain(words)
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _new(self, new: set[str]) -> dict[str, bytes]:
        """The ids of words that are not known."""
        if self.ends is None:
            return dict(zip(new, self._plain(list(new))))
        stems, others = {}, []
        for word in new:
            stem = word[:-1] if word[-1:] in (".", ",") else word
            if stem.isascii() and stem.isalpha():
                stems[word] = stem.lower()
            else:
                others.append(word)
        asked = [w for w in set(stems.values()) if w not in self.known]
        found = dict(zip(asked, self._joined(asked))) if asked else {}
        signs = dict(zip(".,", self._plain([".", ","])))
        out = {}
        for word, stem in stems.items():
            ids = found.get(stem) or self.known[stem]
            out[word] = ids if len(word) == len(stem) else ids + signs[word[-1]]
        return found | out | dict(zip(others, self._plain(others)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in the machine's order of bytes."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        ids = self._new(set().union(*split).difference(self.known))
        if len(self.known) + len(ids) <= self.kept:
            self.known.update(ids)
            get = self.known.__getitem__
        else:
            first, then = self.known.get, ids.get
            get = lambda word: first(word) or then(word, b"")  # noqa: E731  some words have no ids
        return [b"".join(map(get, words)) for words in split]


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def word_tokenizer(definition: str, kept: int) -> WordTokenizer:
    """The tokenizer of this worker process, with the words it knows from earlier tasks."""
    if (definition, kept) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition, kept] = WordTokenizer(definition, kept, split_special=False)
    return _tokenizers[definition, kept]


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, kept_words: int = KEPT_WORDS) -> DataFrame:
    """``(doc_id, shard_key, ids binary)``: the ids of every whole text and the end token behind them."""
    definition = Path(tokenizer).read_text()  # a file of the driver; its content goes to the tasks

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(definition, kept_words)
        last = array(own.code, [end]).tobytes()
        for batch in batches:
            ids = [x + last for x in own.encode(texts_of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "shard_key", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("shard_key"), "text")
    return map_batches(keyed, read, f"doc_id {kind}, shard_key bigint, ids binary")


class Bm25:
    """An inverted index of one shard; terms in half of the documents or more say nothing and have no postings."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        term = np.concatenate(docs).astype(np.int64)
        pairs, tf = np.unique(term * n + np.repeat(np.arange(n), sizes), return_counts=True)
        terms, self.doc = np.divmod(pairs, n)
        self.terms, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(pairs))
        df = np.diff(self.first)
        self.df = np.where(2 * df < n, df, 0)
        idf = np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1.0))
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the different terms of ``query``."""
        at = np.searchsorted(self.terms, np.unique(query))
        count = self.df[at]
        at, count = at[count > 0], count[count > 0]
        if not len(at):
            return np.zeros(self.n)
        ends = np.cumsum(count)
        places = np.arange(ends[-1]) + np.repeat(self.first[at] - ends + count, count)
        return np.bincount(self.doc[places], self.weight[places], minlength=self.n)


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of all pieces of a shard."""
    index = Bm25(docs)
    sizes = np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = room_used = 0
    following = 0
    seed, done = None, 0  # the document at the head and how much of it is placed

    def place(doc: int, begin: int) -> int:
        """Fill the window with ``doc`` from ``begin`` on; returns how far it came."""
        nonlocal room_used, sequence
        length = min(int(sizes[doc]) - begin, window - room_used)
        pieces.append((doc, begin, length, sequence, room_used))
        room_used += length
        if room_used == window:
            sequence, room_used = sequence + 1, 0
        return begin + length

    while True:
        if seed is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                break
            seed, done = following, 0
            unused[seed] = False
        done = place(seed, done)
        while done < sizes[seed]:
            done = place(seed, done)
        head, seed = seed, None
        if not room_used:
            continue
        left = np.flatnonzero(unused)
        order = left[np.argsort(-index.scores(docs[head])[left], kind="stable")]
        for doc in order[: int(np.searchsorted(np.cumsum(sizes[order]), window - room_used)) + 1]:
            doc = int(doc)
            unused[doc] = False
            done = place(doc, 0)
            if not room_used:
                if done < sizes[doc]:
                    seed = doc
                break
    return _power_tails(pieces, sequence, room_used)


def _power_tails(pieces: list[tuple[int, int, int, int, int]], last: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the unfinished sequence ``last`` of ``size`` tokens into sequences whose lengths are powers of two."""
    if not size:
        return pieces
    cuts = [0]
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    out = [p for p in pieces if p[3] != last]
    for doc, start, length, _, offset in (p for p in pieces if p[3] == last):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            low, high = max(a, offset), min(b, offset + length)
            if low < high:
                out.append((doc, start + low - offset, high - low, last + k, low - a))
    return out


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = True, shard_chars: int = SHARD_CHARS,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32`` and, if asked for, ``ids``.

    ``kept_words`` trades memory of the workers, which outlives the job, for time; results do not depend on it.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-chars // shard_chars) or 1
    ids = tokenized(docs, tokenizer, end, kept_words).withColumn("shard", F.pmod("shard_key", F.lit(shards)))
    ordered = ids.repartition("shard").sortWithinPartitions("shard", "shard_key", "doc_id")
    from tokenizers import Tokenizer

    kind = np.dtype(np.uint16 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else np.uint32)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def read(batches):
        for group in grouped_by(batches, "shard"):
            own = [np.frombuffer(x, kind) for x in group.column("ids").to_pylist()]
            pieces = pack_shard(own, window)
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
            base = group.column("shard")[0].as_py() << 32
            parts = [own[d][s : s + n].astype("<u4") for d, s, n, _, _ in pieces]
            arrays = [
                group.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array(np.array([len(x) for x in own])[doc]),
                pa.array(base + sequence), pa.array(offset),
            ]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:7])
    return map_batches(ordered, read, schema + (", ids array<int>" if with_ids else ""))
