"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Of all ways to write a text with the pieces of a vocabulary, encoding takes the one with the highest sum of piece
scores (the library's unigram rule; on a vocabulary of merges it can differ from merging). Spaces are written as
``▁``, a text begins with one, and a character without a piece is written in bytes.

No piece goes from another character over to ``▁``, so a text is cut there into words that are independent. New words
of a batch are sorted by length; words of equal length advance together. Rolling hashes give a key for every
substring, which is looked up among the sorted keys of the pieces; at each place the maximum over all piece
lengths is taken for all words at once and its length stored as backpointer.

Encoding is one scan without a shuffle; the vocabulary has a fixed size and goes out with the task. Decoding is the
exact inverse but for ``▁`` itself, which reads as a space.

Defined cases: null counts as empty; the empty text has no ids; repeated rows give equal rows; other columns
of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm.common import extended, map_batches, sha256, texts_of
from logweave.llm.hashing import mix

SPACE = "▁"
KEPT_WORDS = 500_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 21  # substrings looked up at once
_LONG = 64  # longer words seldom have company of their length
_BLOCK = 1 << 14


class Vocabulary:
    """Pieces with scores, and the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[int, str, float]], bytes_: list[int], unknown: float):
        self.pieces, self.byte_ids, self.unknown = pieces, np.array(bytes_, np.int64), unknown
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in pieces):
            raise ValueError("a piece goes from a character over to a space")
        self.longest = max(len(p) for _, p, _ in pieces)
        keys = np.array([_key(p) for _, p, _ in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a key")
        self.ids = np.array([i for i, _, _ in pieces], np.int64)[order]
        self.scores = np.array([s for _, _, s in pieces])[order]
        self.by_id = {i: p.replace(SPACE, " ").encode("utf-8") for i, p, _ in pieces}
        self.by_id |= {int(i): bytes([b]) for b, i in enumerate(bytes_)}
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, model: bytes) -> "Vocabulary":
        """From a model file of the library."""
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=model)
        used = [i for i in range(len(m)) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        pieces = [(i, m.id_to_piece(i), m.get_score(i)) for i in used]
        least = min(s for _, _, s in pieces)
        return cls(pieces, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], least - 10)

    # --- encoding --------------------------------------------------------------------------------

    def segment(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of the best segmentation of each word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        first = 0
        while first < len(order):
            size = int(sizes[order[first]])
            last = int(np.searchsorted(sizes[order], size, "right"))
            step = max(1, _CELLS // (size * min(size, self.longest) or 1))
            for low in range(first, last, step):
                rows = order[low : min(low + step, last)]
                if size > _LONG:
                    for row in rows:
                        out[row] = self._long(words[row])
                elif size:
                    for row, ids in zip(rows, self._equal_length([words[r] for r in rows], size)):
                        out[row] = ids
            first = last
        return out

    def _equal_length(self, words: list[str], size: int) -> list[tuple[int, ...]]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
        sums = np.zeros((len(words), size + 1), np.uint64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _BASE + chars[:, i] + np.uint64(1)
        best = np.full((size + 1, len(words)), -np.inf)
        best[0] = 0
        length = np.zeros((size + 1, len(words)), np.int32)
        piece = np.full((size + 1, len(words)), -1, np.int64)
        power = np.uint64(1)
        powers = [power]
        for _ in range(min(size, self.longest)):
            power = np.uint64(int(power) * int(_BASE) & (1 << 64) - 1)
            powers.append(power)
        for end in range(1, size + 1):
            for n in range(min(end, self.longest), 0, -1):  # the longer piece wins a tie
                key = mix(sums[:, end] - sums[:, end - n] * powers[n] + np.uint64(n))
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                found = self.keys[at] == key
                score = np.where(found, self.scores[at], self.unknown if n == 1 else -np.inf)
                total = best[end - n] + score
                better = total > best[end]
                best[end][better] = total[better]
                length[end][better] = n
                piece[end][better] = np.where(found, self.ids[at], -1)[better]
        return self._read_back(chars, length, piece)

    def _long(self, word: str) -> tuple[int, ...]:
        """A word that has hardly any of its length beside it: its substrings are looked up at once, then it advances alone."""
        size = len(word)
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        best, length, piece = [0.0] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        for low in range(0, size, _BLOCK):
            # hashes of the substrings that end in this block
            begin, high = max(0, low - self.longest), min(size, low + _BLOCK)
            part = chars[begin:high].astype(np.uint64) + np.uint64(1)
            ways: list[list[tuple[int, float, int]]] = [[] for _ in range(high - low)]
            rolled = np.zeros(len(part), np.uint64)
            for n in range(1, min(self.longest, high) + 1):
                rolled = part[n - 1 :] if n == 1 else rolled[:-1] * _BASE + part[n - 1 :]
                key = mix(rolled + np.uint64(n))
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                ends = np.arange(begin + n, high + 1)
                for k in np.flatnonzero((self.keys[at] == key) & (ends > low)):
                    ways[int(ends[k]) - low - 1].append((n, float(self.scores[at[k]]), int(self.ids[at[k]])))
            for end, known in enumerate(ways, low + 1):
                if not known or known[0][0] > 1:
                    known.insert(0, (1, self.unknown, -1))
                total, n, found = max((best[end - n] + s, n, i) for n, s, i in known)  # the longer piece wins a tie
                best[end], length[end], piece[end] = total, n, found
        ids: list[int] = []
        end = size
        while end:
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids += self.byte_ids[list(word[end - 1].encode("utf-8", "surrogatepass"))[::-1]].tolist()
            end -= length[end]
        return tuple(ids[::-1])

    def _read_back(self, chars: np.ndarray, length: np.ndarray, piece: np.ndarray) -> list[tuple[int, ...]]:
        """Follow the backpointers of all words at once."""
        n, size = chars.shape
        place = np.full(n, size)
        steps = []
        rows = np.arange(n)
        while (place > 0).any():
            live = place > 0
            taken = np.where(live, piece[place, rows], -2)
            start = place - length[place, rows]
            steps.append((taken, start))
            place = np.where(live, start, 0)
        table = np.array([t for t, _ in steps[::-1]]).T.tolist()
        starts = np.array([s for _, s in steps[::-1]]).T
        out = []
        for r, row in enumerate(table):
            if -1 in row:
                ids: list[int] = []
                for k, i in enumerate(row):
                    if i == -1:
                        ids += self.byte_ids[list(chr(chars[r, starts[r, k]]).encode("utf-8", "surrogatepass"))].tolist()
                    elif i >= 0:
                        ids.append(i)
                out.append(tuple(ids))
            else:
                out.append(tuple(i for i in row if i >= 0))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.known))
        ids = dict(zip(new, self.segment(new)))
        if len(self.known) + len(ids) <= KEPT_WORDS:
            self.known.update(ids)
            get = self.known.__getitem__
        else:
            first, then = self.known.get, ids.get
            get = lambda word: first(word) or then(word)
        return [np.array([i for word in words for i in get(word)], np.int64) for words in split]

    # --- decoding --------------------------------------------------------------------------------

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        get = self.by_id.__getitem__
        return [b"".join(map(get, ids.tolist())).decode("utf-8", "replace")[1:] for ids in rows]


def _key(piece: str) -> int:
    total = 0
    for c in piece:
        total = (total * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return int(mix(np.array([(total + len(piece)) & (1 << 64) - 1], np.uint64))[0])


_vocabularies: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    if model not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[model] = Vocabulary.load(model)
    return _vocabularies[model]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text, ids array<int>)``; ``model`` is a model file the driver reads."""
    content = Path(model).read_bytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(content)
        for batch in batches:
            ids = pa.array([x.astype(np.int32) for x in own.encode(texts_of(batch.column(1)))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["doc_id", "text", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), read, f"doc_id {kind}, text string, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``."""
    content = Path(model).read_bytes()
    at = encoded.columns.index("ids")

    def read(batches):
        own = _vocabulary(content)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.decode(rows), pa.string())], [*batch.schema.names, "decoded"])

    return map_batches(encoded, read, extended(encoded, "decoded string"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_sha256, same)``: encode and decode every whole text in one scan."""
    content = Path(model).read_bytes()

    def read(batches):
        own = _vocabulary(content)
        for batch in batches:
            texts = texts_of(batch.column(1))
            rows = own.encode(texts)
            back = own.decode(rows)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in rows]
            same = [a.replace(SPACE, " ") == b for a, b in zip(texts, back)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(crc, pa.int64()), pa.array([sha256(t) for t in back]), pa.array(same)],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same boolean"
    return map_batches(docs.select("doc_id", "text"), read, schema)
