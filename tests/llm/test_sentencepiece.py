import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from logweave.llm import sentencepiece as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(open(MODEL, "rb").read())


def brute(v, text):
    """The highest sum over all segmentations, by the plain recursion over prefixes."""
    if not hasattr(v, "by_piece"):
        score = dict(zip(v.ids.tolist(), v.scores.tolist()))
        v.by_piece = {p: score[i] for i, p, _ in v.pieces}
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            part = text[start:end]
            best[end] = max(best[end], best[start] + v.by_piece.get(part, v.unknown if len(part) == 1 else -np.inf))
    return best[-1]


def total(v, ids):
    if not hasattr(v, "by_number"):
        v.by_number = dict(zip(v.ids.tolist(), v.scores.tolist()))
    return sum(v.by_number[i] for i in ids)


def test_small_vocabulary_all_segmentations():
    pieces = [(300 + i, p, s) for i, (p, s) in enumerate({"▁": -4, "a": -2, "b": -2, "ab": -3, "▁a": -5, "bab": -3.5, "▁▁": -6, "ba": -3}.items())]
    v = S.Vocabulary(pieces, list(range(256)), -100)
    rng = random.Random(0)
    for _ in range(500):
        word = "▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        ids = v.segment([word])[0]
        assert "".join(dict((i, p) for i, p, _ in pieces)[i] for i in ids) == word
        assert abs(sum(dict((i, s) for i, _, s in pieces)[i] for i in ids) - brute(v, word)) < 1e-9


def test_best_score_on_words(vocabulary, sample):
    library = SentencePieceProcessor(model_file=MODEL)
    words = sorted({w for r in sample.collect() for w in r.text.split()})[:1500]
    for word, ids in zip(words, vocabulary.encode(words)):
        if min(ids.tolist()) > 258:
            assert total(vocabulary, ids.tolist()) == brute(vocabulary, "▁" + word)
            other = library.encode(word)
            if min(other) > 258:
                assert total(vocabulary, ids.tolist()) >= total(vocabulary, other)


def test_round_trip(vocabulary):
    texts = ["", " ", "a  b", " x ", "①é\n\t", "日本語 テスト", "a" * 3000, "\U0001F600 x\x00y", "  ", "un▁der"]
    assert vocabulary.decode(vocabulary.encode(texts)) == [t.replace("▁", " ") for t in texts]
    # the library reads the ids back as the same text
    library = SentencePieceProcessor(model_file=MODEL)
    for t in texts[:-1]:
        assert library.decode(vocabulary.encode([t])[0].tolist()) == t


def test_long_words_equal_short_ones_method(vocabulary):
    rng = random.Random(3)
    for word in ["▁" + "".join(rng.choice("thereinéandё日") for _ in range(n)) for n in (1, 2, 40, 100)] + ["▁▁▁", "日本", "▁theand" * 9]:
        assert vocabulary._long(word) == vocabulary._equal_length([word], len(word))[0]
    blocks = "the日in" * 9000  # several blocks
    assert b"".join(vocabulary.by_id[i] for i in vocabulary._long(blocks)).decode() == blocks


def test_words_do_not_depend_on_their_batch(vocabulary):
    words = ["alpha", "betas", "gamma", "unë", "xy"]
    alone = [S.Vocabulary.segment(vocabulary, ["▁" + w])[0] for w in words]
    assert S.Vocabulary.segment(vocabulary, ["▁" + w for w in words]) == alone


def test_query(sample, edges, nothing, vocabulary):
    texts = {r.doc_id: r.text for r in sample.collect()}
    rows = S.round_trip(sample, MODEL).collect()
    for r in rows[:20]:
        ids = vocabulary.encode([texts[r.doc_id]])[0]
        assert (r.n_ids, r.ids_crc32, r.same) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), True)
    assert len(rows) == len(texts) and all(r.same for r in rows)
    out = S.decode_documents(S.encode_documents(edges, MODEL), MODEL).collect()
    assert len(out) == 13 and all(r.decoded == (r.text or "") for r in out)
    assert S.round_trip(nothing, MODEL).count() == 0
