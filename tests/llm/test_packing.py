import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from logweave.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_those_of_the_library():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    own = P.WordTokenizer(open(PATH).read())
    texts = ["Don't\nDON'T  we'll", "a\tb's İstanbul ﬁ ① é é x", "\x1c \x85z\xa0q", "", "  ", "日本 語 12.5€", "<|endoftext|> x"]
    for _ in range(2):
        assert [np.frombuffer(x, np.uint16).tolist() for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_scores_equal_the_formula():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 30, rng.integers(1, 12)) for _ in range(25)]
    index, query = P.Bm25(docs), docs[4]
    mean = np.mean([len(d) for d in docs])
    for got, d in zip(index.scores(query), docs):
        want = 0.0
        for t in set(query.tolist()):
            df, tf = sum(t in x for x in docs), (d == t).sum()
            if tf and 2 * df < len(docs):
                want += np.log((25 - df + 0.5) / (df + 0.5)) * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(d) / mean))
        assert abs(got - want) < 1e-9


def test_neighbours_share_a_window():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * t, 100 * t + 40, (10, 60)) for t in range(20)]
    docs = [topics[t][i] for i in range(10) for t in range(20)]  # topics are far apart in the order given
    by_window = {}
    for doc, _, _, sequence, _ in P.pack_shard(docs, 300):
        by_window.setdefault(sequence, []).append(doc % 20)
    same = [max(w.count(t) for t in w) / len(w) for w in by_window.values()]
    assert np.mean(same) > 0.8


def check(rows, ids):
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for spans, total in [(s, len(ids[d])) for d, s in pieces.items()] + [(s, sum(n for _, n in s)) for s in sequences.values()]:
        at = 0
        for begin, n in sorted(spans):
            assert begin == at and n > 0
            at += n
        assert at == total
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= 2048 and all(s & (s - 1) == 0 for s in sizes)  # nothing is padded


def test_joined_words_have_the_ids_of_the_plain_call(sample):
    plain, own = Tokenizer.from_file(PATH), P.WordTokenizer(open(PATH).read(), kept=3000, split_special=False)
    assert own.ends is not None
    texts = [r.text or "" for r in sample.limit(60).collect()]
    texts += ["Word. WORD, word Word,. a.b c,d e.. 's it's don't, X. , . ., Ab1. aé. É, ß. ſt,", "", ". . ,", "I'LL. we'RE, o'd"]
    for _ in range(2):  # the second time some words are known
        assert [np.frombuffer(x, own.code).tolist() for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_against_the_library(spark, sample):
    plain = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in sample.collect()}
    check(P.pack(sample, PATH, with_ids=False).collect(), ids)
    rows = P.pack(sample, PATH, shard_chars=50_000).collect()
    check(rows, ids)
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in rows)


def test_edges(edges, nothing):
    rows = P.pack(edges, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id == 8) == 14
    assert P.pack(nothing, PATH).count() == 0


def test_literal_special_tokens_have_the_ids_of_the_plain_call():
    plain = Tokenizer.from_file(PATH)
    words = P.word_tokenizer(open(PATH).read(), 1000)
    texts = ["<|endoftext|>", "a <|startoftext|> b", "one<|endoftext|>two <|endoftext|><|startoftext|>", "x\n<|endoftext|>\ny", "no such token"]
    got = [np.frombuffer(x, words.code).tolist() for x in words.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in got[0] and 49406 in got[1]
