import random
import re

import numpy as np
import pytest

from logweave.llm import jaccard as J


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    near = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    name = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in name:
                name[j] = i
                todo += near[j]
    return {i: (name[i], len(near[i])) for i in sets}


def found(docs):
    return {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(docs).collect()}


def make(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 2, 6, 30])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_equals_all_pairs(spark, seed):
    rows = make(seed)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_large_buckets_are_split_and_paired(spark, monkeypatch):
    rows = make(3)
    monkeypatch.setattr(J, "BLOCK_NODES", 7)
    monkeypatch.setattr(J.buckets, "__defaults__", (6, 2))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_overlaps():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 40, 90):
        base = rng.integers(0, 1 << 62, 60)
        sets = [set(rng.choice(base, 48, replace=False).tolist()) | set(rng.integers(0, 50, 8).tolist()) for _ in range(n)]
        members = np.array([x for s in sets for x in s], np.uint64)
        out = J.overlaps(members, np.repeat(np.arange(n), [len(s) for s in sets]), n)
        assert all(out[i, j] == len(sets[i] & sets[j]) for i in range(n) for j in range(n) if i != j)


def test_runs_for_the_recall():
    assert J.runs_needed(0.999) > J.runs_needed(0.9) >= 1


def test_edges(edges, nothing):
    rows = J.near_duplicates(edges).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and by[1].n_links == by[2].n_links == by[3].n_links == 0
    assert by[5].class_id == by[6].class_id == 5 and by[8].n_links == 1
    assert J.near_duplicates(nothing).count() == 0
    kept = J.one_per_class(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7, 8, 9, 10]
