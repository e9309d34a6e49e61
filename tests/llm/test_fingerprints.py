import hashlib
import random

import numpy as np

from logweave.llm import fingerprints as P


def walk(text):
    """The embeddings of one text, step by step; the samples are read off them."""
    steps, _, records, odd = P._fixed()
    if not text:
        return bytes(P.SLOTS)
    out = []
    for slot in range(P.SLOTS):
        each = P.SLOTS // P.WALKS
        if slot % each == 0:
            under = []  # the place under the pointer at every step
            for i, c in enumerate(text):
                kind = (ord(c) ^ (ord(c) >> 8)) & 255
                under += [i] * int(steps[slot // each][kind * P._PERIOD + len(under) % P._PERIOD])
        step = int(max(r for r in records[slot] if r < 2 * len(text)))
        at = under[min(step, len(under) - 1)]
        gram = sum(ord(text[at + k]) << (21 * k) for k in range(3) if at + k < len(text))
        out.append(int(P.mix(np.array([gram * int(odd[slot]) + step & (1 << 64) - 1], np.uint64))[0]) >> 56)
    return bytes(out)


def test_batched_walk_equals_the_single_one():
    rng = random.Random(2)
    texts = ["", "a", "ab", "é日\U0001F600" * 5] + ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10, 1023, 1024, 1025, 5000, 9000)]
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) for _ in range(3 * P._FEW)]
    got = P.fingerprints(texts)
    for text, row in zip(texts, got):
        assert sum(a != b for a, b in zip(row.tobytes(), walk(text))) == 0, text[:20]


def test_a_sentence_more_keeps_long_texts_alike():
    """In front of a text and in its middle; the share of texts that stay alike grows with their length."""
    alike = {}
    for seed in range(24):
        rng = random.Random(seed)
        words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
        for size in (1100, 3200, 11000):
            text = " ".join(rng.choice(words) for _ in range(size))
            more = " ".join(rng.choice(words) for _ in range(11)) + ". "
            half = text.index(" ", len(text) // 2) + 1
            own = P.fingerprints([text, more + text, text[:half] + more + text[half:]])
            alike.setdefault(size, []).append(P.likeness(own[1:], own[:1]) > 0.7)
    front, middle = zip(*(np.mean(alike[size], axis=0) for size in (1100, 3200, 11000)))
    assert front[0] >= 0.7 and front[1] >= 0.85 and front[2] >= 0.95 and min(middle[1:]) >= 0.85, (front, middle)
    few = P.fingerprints(["".join(rng.choice("abcdefg hij") for _ in range(6000)) for _ in range(30)])
    assert max(P.likeness(few[i + 1 :], few[i : i + 1]).max(initial=0) for i in range(29)) < 0.3


def test_likeness_falls_with_edits():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    few = list(text)
    for at in rng.sample(range(4000), 8):
        few[at] = "z"
    a, b, c, d = P.fingerprints([text, "".join(few), P.edited(text, other), other])
    near = [float((a == x).mean()) for x in (b, c, d)]
    assert near[0] > 0.85 > near[1] > 0.4 > 0.1 > near[2]


def brute(rows):
    order = sorted(rows, reverse=True)
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        yield doc_id, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def test_query_equals_brute_force(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    for parts in (1, 5):
        docs = sample.repartition(parts)
        got = P.compare_with_next(docs).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute(rows))
        assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    prints = {}
    texts = dict(rows)
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_near_texts_are_linked(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(3000)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:1500] + "!" + t[1500:]) for i, t in enumerate(texts)] + [(200, texts[3])]
    found = {r.doc_id: r.near_id for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[i] == found[100 + i] == i for i in range(20)) and found[200] == 3


def test_a_smaller_document_of_the_bucket_hides_no_link(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(0, 256, P.SLOTS, np.uint8)
    c, a = b.copy(), rng.integers(0, 256, P.SLOTS, np.uint8)
    c[4::4] ^= 1  # alike, and only the first band is the same
    a[:4] = b[:4]
    rows = list(zip((1, 2, 3), P.as_text(np.stack([a, b, c]))))
    found = {r.fingerprint: r.near_id for r in P.link_near(spark.createDataFrame(rows, "doc_id bigint, fingerprint string")).collect()}
    assert [found[f] for _, f in rows] == [1, 2, 2]


def test_links_of_a_bucket_of_many_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 256, (40, P.SLOTS), np.uint8)[rng.integers(0, 40, 300)]
    prints[rng.random(prints.shape) < 0.12] = 0
    prints[:, :4] = 7  # a passage that all texts hold
    ids = [int(i) if i % 9 else None for i in rng.permutation(300)]
    rows = list(zip(ids, P.as_text(prints)))
    expected = {}
    for i, (own, name) in enumerate(rows):
        near = [ids[j] for j in range(300) if ids[j] is not None and (prints[i] == prints[j]).mean() >= P.ALIKE]
        expected[name] = min(near, default=None)
    docs = spark.createDataFrame(rows, "doc_id bigint, fingerprint string")
    for block in (1024, 50):
        assert {r.fingerprint: r.near_id for r in P.link_near(docs, block=block).collect()} == expected


def test_edges(spark, edges, nothing):
    rows = P.fingerprint_documents(edges).collect()
    assert len(rows) == 13 and len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert P.fingerprint_documents(nothing).count() == 0
    one = P.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id int, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
