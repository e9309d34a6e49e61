import zlib

import numpy as np

from logweave.llm import language as L
from logweave.llm.common import utf8


def test_gradients_equal_differences():
    net = L.Network.start(["a", "b", "c"], 4, 1)
    net = L.Network(net.labels, *[p.astype(np.float64) for p in net.parameters])
    rng = np.random.default_rng(0)
    text, gold = rng.integers(0, 256, (9, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    used = np.arange(9)[:, None] < np.array([9, 9, 4, 9, 1, 7])
    _, grads = L.gradients(net, text, used, gold)
    for p, g in zip(net.parameters, grads):
        for at in (np.unravel_index(k, g.shape) for k in np.argsort(-np.abs(g).ravel())[:5]):
            old = p[at]
            p[at] = old + 1e-4
            up = L.gradients(net, text, used, gold)[0]
            p[at] = old - 1e-4
            down = L.gradients(net, text, used, gold)[0]
            p[at] = old
            assert abs((up - down) / 2e-4 - g[at]) < 1e-4


def test_prediction_reads_every_byte_in_windows():
    import pyarrow as pa

    net = L.Network.start(["a", "b"], L.HIDDEN, 3)
    texts = ["x", "", "äbc" * 200, "hello " * 41]
    got = L.predict(net, *utf8(pa.array(texts)))
    for text, row in zip(texts, got):
        data, sums = text.encode(), np.zeros(2)
        for k in range(0, len(data), L.WINDOW):
            part = np.frombuffer(data[k : k + L.WINDOW], np.uint8)[:, None]
            both = np.concatenate([L._read(net, way, part, False)[0] for way in (0, 1)], axis=1)
            sums += L._label(net, both)[:, :, 0].sum(axis=0)
        assert np.allclose(row, sums / max(1, len(data)), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_only_outside_the_fold(spark):
    docs = spark.createDataFrame(
        [(i, "ab cd " * 50, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy", "s", 1) for i in range(40)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    assert {label for _, label in L.sample_windows(docs)} == {"yy"}


def test_edges(edges, nothing):
    rows = L.identify(edges).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and rows[0].hash == 0.5
    for i in (1, 2, 3, 9):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[8].lang_pred == "en" and L.identify(nothing).count() == 0
