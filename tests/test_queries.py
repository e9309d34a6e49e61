import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

# one or two queries per area; the driver compares all of them on more data
COMPARED = [
    "field_extraction", "preset_lines", "tokens", "time_buckets", "level_frequency_1_hour", "log_roll_up", "level_roll_up", "template_roll_up", "template_table",
    "template_transition_gapped", "template_dwell", "template_cooccurrence_6_hours", "brain_tuned", "ael",
    "drain", "drain_conversations", "jaccard_drain", "spell", "ael_partial_merge", "extract_several_files", "page", "registry_insert", "vector_neighbours",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == expected and got


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "value"] and df.count() > 0
