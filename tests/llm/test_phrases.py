import re
from collections import Counter

import numpy as np
import pytest

from logweave.llm import phrases as P


def brute(rows, support, top=P.TOP):
    """Every contiguous run of words, counted in a dictionary."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= support}
    longer = Counter()
    for (lang, p), a in f.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                longer[lang, p[i : i + size]] = max(longer[lang, p[i : i + size]], a)
    out = {}
    for (lang, p), a in f.items():
        if len(p) >= 2 and 100 * longer[lang, p] < 100 * a:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])
    )


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{i}" for i in range(30)] + ["Ünï", "日本", "A", "a"])
    rows = []
    for i in range(400):
        drawn = vocabulary[np.minimum(rng.zipf(1.4, rng.integers(0, 60)) - 1, len(vocabulary) - 1)]
        ends = rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "!"], len(drawn))
        rows.append((["en", "de", None, "und"][i % 4], "".join(w + e for w, e in zip(drawn, ends))))
    rows += [("en", "The same Licence line stands in a third of all texts.")] * 70 + [("de", "x x x x x x x x x")] * 9
    return rows


@pytest.mark.parametrize("budget, dictionary", [(10**6, 1 << 20), (20, 0)])
def test_against_counting_everything(spark, mixed, budget, dictionary):
    table = spark.createDataFrame(mixed, "lang string, text string")
    want = brute(mixed, 8)
    assert len(want) > 150 and any(len(r[2].split()) == 5 for r in want)
    assert got(P.collocations(table, support=8, budget=budget, dictionary_bytes=dictionary)) == want


def test_ties_and_top(spark, mixed):
    table = spark.createDataFrame(mixed, "lang string, text string")
    assert got(P.collocations(table, support=8, top=7)) == brute(mixed, 8, 7)


def test_edges(spark, edges, nothing):
    want = brute([(r.lang, r.text) for r in edges.select("lang", "text").collect()], 2)
    assert want and got(P.collocations(edges, support=2)) == want
    assert got(P.collocations(edges, support=2, budget=100, dictionary_bytes=0)) == want
    assert P.collocations(nothing).count() == 0 and P.collocations(edges, support=10**6).count() == 0


def test_groups_keep_the_budget(spark, mixed):
    table = spark.createDataFrame(mixed, "lang string, text string")
    counts = P.stored(P.word_counts(table).where("word is not null and f >= 8"))
    known = P.stored(P.with_rank(counts, [P.F.col("lang"), P.F.col("word")], "id"))
    size, runs = known.count(), P.stored(P.runs_by_broadcast(table, known))
    pairs = P.stored(P.pair_counts(runs, size).where("f >= 8"))
    bits = P.BitTable.of(pairs, pairs.count())
    groups, _ = P.partition(runs, pairs, bits, size, 60)
    assert groups.beyond and max(groups.beyond) >= 3
    held = P.leaves(runs, bits, groups).groupBy("group").agg(P.F.sum("f").alias("f")).where("group % 8 < 5").toPandas()
    assert held.f.max() <= 120
    assert sorted(map(tuple, P.runs_by_join(table, known).collect()))  # the same runs, cut into other rows
    joined = P.pair_counts(P.runs_by_join(table, known), size).where("f >= 8")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, pairs.collect()))


def test_words_that_share_a_key(spark, mixed, monkeypatch):
    rows = [(lang, text) for lang, text in mixed if text][:60]
    monkeypatch.setattr(P, "_keys", lambda hashes, lang: hashes % np.uint64(5))
    batch = P.pa.RecordBatch.from_arrays([P.pa.array([r[0] for r in rows]), P.pa.array([r[1] for r in rows])], ["lang", "text"])
    langs: list = []
    (s,) = P._slices(batch, langs)
    texts = P._texts(s.data, s.starts, s.ends)
    names = sorted({(langs[i], w) for i, w in zip(s.lang, texts)})
    table = P.pa.table({"lang": [n[0] for n in names], "word": [n[1] for n in names], "id": list(range(len(names)))})
    dictionary = P.Dictionary.of(table)
    assert dictionary.copies > 3
    s.lang = np.array([dictionary.langs.index(langs[i]) for i in s.lang])
    found = dictionary.look_up(s)
    assert [names[i][1] for i in found] == texts
