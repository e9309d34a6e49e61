import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logweave.llm import jaccard, pii, queries, substrings

from tests.llm.test_jaccard import brute as near
from tests.llm.test_pii import brute as personal

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, sample):
    kept = corpus_pipeline.language_id(spark, sample, SF)
    assert {r.doc_id for r in sample.collect() if re.search(r"[a-z]{3}.*[a-z]{3}", r.text)} <= {r.doc_id for r in kept.collect()}
    once = corpus_pipeline.jaccard_join(spark, kept, SF)
    classes = near([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, (name, _) in classes.items() if i == name)
    cut = corpus_pipeline.substring_dedup(spark, once, SF)
    seen = set()
    for r in sorted(cut.collect()):
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        own = [tuple(words[i : i + 40]) for i in range(len(words) - 39)]
        assert not seen & set(own) and r.n_chars == len(r.text)
        seen |= set(own)
    clean = corpus_pipeline.personal_data(spark, cut, SF)
    before = {r.doc_id: r.text for r in cut.collect()}
    for r in clean.collect():
        assert not [s for s in personal(r.text) if s[0] != "ip"] and r.n_chars == len(r.text)
        if not personal(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    packed = corpus_pipeline.retrieval_packing(spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    for df in (kept, once, cut, clean):
        assert df.columns == sample.columns


def test_run_gives_the_same_as_its_stages(spark, sample):
    docs = sample
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    order = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows(corpus_pipeline.run(spark, SF).select(order)) == rows(docs.select(order))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_edges(spark, edges, nothing, stage):
    out = stage[1](spark, edges, SF)
    assert out.count() > 0 and stage[1](spark, nothing, SF).count() == 0
    if stage[0] != "retrieval_packing":
        assert out.columns == edges.columns


def test_registered_once_per_operator(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    result = db.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(map(str, r)) for r in result.fetchall())
    df = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want
