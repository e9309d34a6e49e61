"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Each window of ``WINDOW`` bytes is read from both ends by a gated recurrent unit of ``HIDDEN`` cells; a
softmax over both states labels every byte, and the probabilities of all bytes of a text are averaged.
Gates and cells use ``x / (1 + |x|)`` in place of the exponential functions, which is several times
cheaper and has a derivative as simple. Training is backpropagation through time with Adam.

The network is fitted on the driver on a bounded sample of labelled rows (``SAMPLE_ROWS`` rows per label
expected, one window of each, all drawn by a hash of the id). It never sees label, source or id when
it predicts. Prediction reads every byte of every text, one scan without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row
everything is ``und``; a null id counts as the empty text for the fold; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import extended, map_batches, utf8

HIDDEN = 6
WINDOW = 128
SAMPLE_ROWS = 600
MOST_LABELS = 200
STEPS = 240
BATCH = 128
COLUMNS = 2048  # windows read side by side
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Two directions side by side: ``x`` byte tables, ``u`` recurrent weights, ``w`` and ``c`` the output."""

    labels: list[str]
    x: np.ndarray  # (2, 3H, 256)
    u: np.ndarray  # (2, 3H, H)
    b: np.ndarray  # (2, H) of the recurrent candidate
    w: np.ndarray  # (labels, 2H)
    c: np.ndarray  # (labels,)

    @classmethod
    def start(cls, labels: list[str], hidden: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            labels, draw(2, 3 * hidden, 256, scale=0.5), draw(2, 3 * hidden, hidden, scale=hidden**-0.5),
            np.zeros((2, hidden), np.float32), draw(len(labels), 2 * hidden, scale=0.3), np.zeros(len(labels), np.float32),
        )

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.w, self.c]


def _read(net: Network, way: int, text: np.ndarray, keep: bool, inside: np.ndarray | None = None):
    """States after each byte of ``text`` (steps, columns) in one direction, and what the way back needs.

    Outside of ``inside`` the state stays zero, so that a window reads alike whatever stands beside it.
    """
    steps, n = text.shape
    h3 = net.u.shape[1]
    h = h3 // 3
    x, u, b = net.x[way], net.u[way], net.b[way][:, None]
    states = np.empty((steps, h, n), x.dtype)
    kept: list = [None] * steps
    state = np.zeros((h, n), x.dtype)
    given, back = np.empty((3 * h, n), x.dtype), np.empty((3 * h, n), x.dtype)
    room = np.empty((2 * h, n), x.dtype)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        np.take(x, text[t], axis=1, out=given, mode="clip")
        np.matmul(u, state, out=back)
        gates, inner, cand = given[: 2 * h], back[2 * h :], given[2 * h :]
        gates += back[: 2 * h]
        np.abs(gates, out=room)
        room += 1
        gates /= room
        soft = gates.copy() if keep else None
        gates *= 0.5
        gates += 0.5
        z, r = gates[:h], gates[h:]
        inner += b
        before = inner.copy() if keep else None
        inner *= r
        cand += inner
        np.abs(cand, out=room[:h])
        room[:h] += 1
        cand /= room[:h]
        if keep:
            kept[t] = (state, soft, z.copy(), r.copy(), before, cand.copy())
        new = states[t]
        np.subtract(state, cand, out=new)
        new *= z
        new += cand
        if inside is not None:
            new *= inside[t]
        state = new
    return states, kept


def _label(net: Network, both: np.ndarray) -> np.ndarray:
    """Probabilities (steps, labels, columns)."""
    logits = np.matmul(net.w, both) + net.c[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, text: np.ndarray, used: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the bytes ``used`` and its gradients, by backpropagation through time."""
    steps, n = text.shape
    h = net.u.shape[2]
    inside = used.astype(net.x.dtype)
    runs = [_read(net, way, text, True, inside) for way in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=1)
    p = _label(net, both)
    weight = (used / max(1, used.sum())).astype(np.float32)
    loss = float(-(np.log(p[:, gold, np.arange(n)] + 1e-9) * weight).sum())
    p[:, gold, np.arange(n)] -= 1
    p *= weight[:, None, :]
    dw, dc = np.einsum("tln,thn->lh", p, both, optimize=True), p.sum(axis=(0, 2))
    dboth = np.matmul(net.w.T, p)
    dx, du, db = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.b)
    for way in (0, 1):
        kept, from_above = runs[way][1], dboth[:, way * h : (way + 1) * h]
        later = np.zeros((h, n), np.float32)
        for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
            state, soft, z, r, inner, cand = kept[t]
            d = (from_above[t] + later) * inside[t]
            dcand = d * (1 - z) * (1 - np.abs(cand)) ** 2
            dinner = dcand * r
            dgates = np.concatenate([d * (state - cand), dcand * inner]) * 0.5 * (1 - np.abs(soft)) ** 2
            dback = np.concatenate([dgates, dinner])
            du[way] += dback @ state.T
            db[way] += dinner.sum(axis=1)
            dgiven = np.concatenate([dgates, dcand])
            np.add.at(dx[way].T, text[t], dgiven.T)
            later = d * z + net.u[way].T @ dback
    return loss, [dx, du, db, dw, dc]


def train(windows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network | None:
    """Fit a network on labelled windows, labels drawn evenly; ``None`` without windows."""
    labels = sorted({label for _, label in windows})
    if not labels:
        return None
    net = Network.start(labels, hidden, seed)
    text = np.zeros((WINDOW, len(windows)), np.uint8)
    used = np.zeros((WINDOW, len(windows)), bool)
    for i, (window, _) in enumerate(windows):
        part = window[:WINDOW]
        text[: len(part), i] = np.frombuffer(part, np.uint8)
        used[: len(part), i] = True
    gold = np.array([labels.index(label) for _, label in windows])
    share = 1 / np.bincount(gold)[gold]
    share /= share.sum()
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters]
    second = [np.zeros_like(p) for p in net.parameters]
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=share)
        at = 64 * int(rng.integers(0, WINDOW // 64))  # half windows are enough to learn from
        _, grads = gradients(net, text[at : at + 64, pick], used[at : at + 64, pick], gold[pick])
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, m, v in zip(net.parameters, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def predict(net: Network, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Mean label probabilities (rows, labels) over all bytes of each text."""
    sizes = np.diff(places)
    pieces = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = places[row] + nth * WINDOW
    length = np.minimum(WINDOW, places[row + 1] - start)
    order = np.argsort(length, kind="stable")
    sums = np.zeros((len(sizes), len(net.labels)))
    for k in range(0, len(order), COLUMNS):
        part = order[k : k + COLUMNS]
        steps = int(length[part].max())
        at = start[part] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[part]
        text = data[np.minimum(at, len(data) - 1)]
        text[~inside] = 0
        mask = None if inside.all() else inside.astype(np.float32)
        p = _label(net, np.concatenate([_read(net, way, text, False, mask)[0] for way in (0, 1)], axis=1))
        np.add.at(sums, row[part], np.einsum("tln,tn->nl", p, inside.astype(np.float32), optimize=True))
    return sums / np.maximum(sizes, 1)[:, None]


def fold(doc_id: str = "doc_id"):
    """``crc32`` of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def sample_windows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, str]]:
    """About ``rows`` labelled rows per label outside fold 2, a window of each; at most ``MOST_LABELS`` labels.

    The share drawn of a label follows from its count, so what reaches the driver is bounded.
    """
    known = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, rows / r["count"]))])[F.col("lang")]
    key = F.xxhash64(F.col("doc_id"), F.length("text"))
    chance = F.pmod(key, F.lit(1 << 30)) / F.lit(1 << 30)
    begin = F.pmod(F.shiftright(key, 30), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    part = F.substring(F.col("text"), begin.cast("int"), F.lit(WINDOW))
    drawn = known.where(chance < share).select("doc_id", F.encode(part, "utf-8").alias("part"), "lang").collect()
    drawn.sort(key=lambda r: (str(r["doc_id"]), bytes(r["part"])))
    return [(bytes(r["part"]), r["lang"]) for r in drawn]


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced. Trains if no network is given."""
    docs = docs.drop("lang_pred", "score")
    net = net or train(sample_windows(docs))
    at = docs.columns.index("text")
    names = net.labels if net else []

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            lettered = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            if net and lettered.any():
                chances = predict(net, *utf8(texts))
                best = chances.argmax(axis=1)
                score = np.where(lettered, np.clip(chances[np.arange(len(best)), best], 0, 1), 0.0)
                pred = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            else:
                pred, score = [UNKNOWN] * len(lettered), np.zeros(len(lettered))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return map_batches(docs, label, extended(docs, "lang_pred string, score double"))
