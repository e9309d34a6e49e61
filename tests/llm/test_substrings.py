import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import hashing
from logweave.llm import substrings as S
from logweave.llm.common import utf8


def brute(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone |= set(range(i, i + length))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def digests(found):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.repeat_digest(found).collect()}


def test_words_and_runs():
    texts = ["a b  c", None, "", "xx a b c", " \t", "b", "é\tü a\vb"]
    data, places = utf8(pa.array(texts))
    found = hashing.words(data, places)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(found.first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert [bytes(data[a:b]).decode() for a, b in zip(found.starts, found.ends)] == flat
    assert len(set(found.hashes.tolist())) == len(set(flat))
    whole = [i for i in range(len(flat)) if any(f <= i and i + 3 <= g for f, g in zip(found.first, found.first[1:]))]
    assert hashing.inside_row(found.first, 3).tolist() == whole


def test_automaton_against_search():
    rng = random.Random(8)
    reference = [[rng.choice("abc") for _ in range(rng.randint(1, 30))] for _ in range(6)]
    automaton = S.SuffixAutomaton()
    for passage in reference:
        automaton.add(passage)
    texts = ["".join(p) for p in reference]
    for _ in range(300):
        passage = [rng.choice("abc") for _ in range(25)]
        for least in (3, 5):
            hit = [i for i in range(25 - least + 1) if any("".join(passage[i : i + least]) in t for t in texts)]
            covered = {j for a, b in automaton.covered(passage, least) for j in range(a, b)}
            assert covered == {j for i in hit for j in range(i, i + least)}


@pytest.mark.parametrize("vocabulary,length", [(2, 4), (3, 6), (40, 20)])
def test_random_texts_equal_brute_force(spark, vocabulary, length):
    rng = random.Random(vocabulary)
    passages = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(3, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 12))) for _ in range(5)]
        rows.append((i * 3, "  ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digests(S.find_repeats(docs, length, shard_words=50, load_words=200)) == brute(rows, length)
    assert digests(S.find_repeats(docs, length, shard_words=50, load_words=200, room=0)) == brute(rows, length)


def test_runs_of_repeated_windows_are_one_row(spark):
    """Long passages that come whole are shuffled as runs; where passages differ or hold a window twice, as windows."""
    rng = random.Random(21)
    passages = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(6)]
    edge = [p.split() for p in passages]
    round_ = " ".join(f"k{i % 7}" for i in range(120))
    rows = [(i, f"h{i} {rng.choice(passages)} t{i}") for i in range(40)]
    rows += [(100 + i, " ".join(edge[i][:200] + [f"n{i}"] + edge[i][200:])) for i in range(6)] + [(200, round_), (201, f"x {round_}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digests(S.find_repeats(docs, shard_words=300, load_words=900)) == brute(rows, S.LENGTH)
    regions = S._regions(S._keyed(docs), S.LENGTH, S.GRAM, 1 << 20)
    keys = S._ambiguous(regions, S.LENGTH, S.GRAM)
    table = spark.sparkContext.broadcast(S.BitTable.of(keys, keys.count()))
    every = spark.sparkContext.broadcast(S.BitTable(16, np.full(1 << 13, 255, np.uint8)))
    pieces, windows = (S._pieces(regions, S.LENGTH, S.GRAM, t) for t in (table, every))
    total = windows.count()
    assert {r["size"] for r in windows.select("size").distinct().collect()} == {1}
    assert sorted((r._id, r.pos + k) for r in pieces.collect() for k in range(r["size"])) == sorted((r._id, r.pos) for r in windows.collect())
    assert pieces.count() < total / 3


def test_query_equals_brute_force(sample):
    assert digests(S.find_repeats(sample)) == brute([(r.doc_id, r.text) for r in sample.collect()], S.LENGTH)


def test_cut_text_keeps_other_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"x\n{passage}\ty"), (2, f"a  b\n{passage}\n\nc  d"), (3, passage)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in S.without_repeats(docs).collect()} == {1: f"x\n{passage}\ty", 2: "a  b\nc  d", 3: ""}


def test_edges(edges, nothing):
    out = S.without_repeats(edges)
    assert out.columns == edges.columns
    rows = out.collect()
    by = {r.doc_id: r.text for r in rows}
    assert len(rows) == 13 and by[6] == "" and len(by[5]) > 1000 and by[7] == "y" * 200_000 and by[1] is None
    assert {r.repeats for r in rows} == {"mine"} and {r._id for r in rows} == {"own"}
    assert S.repeat_digest(S.find_repeats(nothing)).count() == 0
