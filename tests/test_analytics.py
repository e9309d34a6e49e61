import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweave.plans import analytics, browse, embedding
from logweave.plans.extract import template_table

LINES = [
    (1, "2024-01-01 00:00:00", "INFO", "a"),
    (2, "2024-01-01 00:00:07", "WARN", "b"),
    (3, "2024-01-01 00:00:05", "INFO", "a"),
    (4, None, "INFO", None),
    (5, "2024-01-01 00:01:00", "INFO", "a"),
    (6, None, None, "c"),
    (7, "2024-01-01 00:01:30", "INFO", "b"),
    (9, "2024-02-01 00:00:00", "ERROR", "c"),
]


@pytest.fixture(scope="module")
def s(spark):
    rows = spark.createDataFrame(LINES, "LineID long, t string, Level string, Template string")
    return rows.withColumn("Timestamp", F.col("t").cast("timestamp")).drop("t")


@pytest.fixture(scope="module")
def t(s):
    return template_table(s)


def cells(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


A, B, C = 0, 1, 2


def test_template_ids(t):
    assert {r["Template"]: r["template_id"] for r in t.collect()} == {"a": A, "b": B, "c": C}


def test_counts(s, t):
    assert {r["name"]: r["n"] for r in analytics.log_counts(s, t).collect()} == {"lines": 8, "templates": 3}
    assert [tuple(r) for r in analytics.level_distribution(s).collect()] == [
        (None, 1), ("ERROR", 1), ("INFO", 5), ("WARN", 1)
    ]
    assert Counter(r["Count"] for r in analytics.log_frequency(s).collect()) == Counter([3, 2, 1, 2])
    per_month = {r["bucket"]: r["Count"] for r in analytics.template_frequency(s, "1 month").collect()}
    assert sorted(per_month.values()) == [1, 1, 2] and per_month[None] == 1
    assert len(analytics.level_frequency(s, "1 month").collect()) == 5
    with pytest.raises(ValueError, match="Level"):
        analytics.level_distribution(s.drop("Level"))
    with pytest.raises(ValueError, match="Level"):
        analytics.level_frequency(s.drop("Level"))


def test_transition(s, t):
    # a b a a c b c, as line 4 has no template
    expected = {(A, B): 1, (B, A): 1, (A, A): 1, (A, C): 1, (C, B): 1, (B, C): 1}
    transition = analytics.template_transition(s, t)
    assert cells(transition) == expected
    probability = cells(analytics.transition_probability(transition))
    assert probability[(A, B)] == pytest.approx(1 / 3) and probability[(C, B)] == 1
    assert cells(analytics.log_scaled(transition))[(A, B)] == pytest.approx(math.log(2))


def test_dwell(s, t):
    dwell = cells(analytics.template_dwell(s, t))
    assert dwell[(A, B)] == 7 and dwell[(B, A)] == -2 and dwell[(A, A)] == 55
    assert dwell[(A, C)] is None and dwell[(C, B)] is None  # line 6 has no time


def test_dwell_cuts_toward_zero(spark):
    rows = [(i, s, t) for i, (s, t) in enumerate([(0, "a"), (1, "b"), (1, "a"), (3, "b"), (10, "b"), (9, "b"), (9, "b")])]
    df = spark.createDataFrame(rows, "LineID long, sec long, Template string").select(
        "LineID", F.timestamp_seconds("sec").alias("Timestamp"), "Template"
    )
    got = cells(analytics.template_dwell(df, template_table(df)))
    b, a = 0, 1
    assert got == {(a, b): 1, (b, a): 0, (b, b): 2}


@pytest.mark.parametrize("tile", [1, 2, 1024])
def test_cooccurrence(s, t, tile):
    assert cells(analytics.template_cooccurrence(s, t, "1 minute", tile=tile)) == {(A, B): 2}
    assert cells(analytics.template_cooccurrence(s, t, "1 month", symmetric=True, tile=tile)) == {(A, B): 1, (B, A): 1}


def test_cooccurrence_packed_equals_unpacked(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.col("id").alias("LineID"),
        F.timestamp_seconds(F.col("id") * 7).alias("Timestamp"),
        F.concat(F.lit("t"), (F.col("id") * F.col("id") % 23).cast("string")).alias("Template"),
    )
    templates = template_table(rows)
    results = []
    for forced in (1, 64):
        monkeypatch.setattr(analytics, "_packing", lambda present: (forced, 22))
        results.append(cells(analytics.template_cooccurrence(rows, templates, "1 minute")))
    assert results[0] == results[1] and len(results[0]) > 20


def test_dense(s, t):
    transition = analytics.template_transition(s, t)
    rows = {r["i"]: tuple(r["cells"]) for r in analytics.dense(transition, 3).collect()}
    assert rows == {A: (1, 1, 1), B: (1, 0, 1), C: (0, 1, 0)}
    assert [len(r["cells"]) for r in analytics.dense(transition, 3000).where("i = 2999").collect()] == [3000]


def test_colour_scale(spark):
    df = spark.createDataFrame([(0, i, i) for i in range(101)], "i long, j long, value long")
    scale = analytics.colour_scale(df).first()
    assert scale["p99"] == pytest.approx(99.01) and scale["max"] == 100
    assert tuple(analytics.colour_scale(df.where("value < 0")).first()) == (None,) * 4


def test_value_page(s):
    everything = [tuple(r) for r in browse.value_histogram(s, "Template").collect()]
    got, total = browse.value_page(s, "Template", 1, 2)
    assert [tuple(r) for r in got.collect()] == everything[1:3] and total == len(everything) > 2


def test_browse(s):
    assert browse.row_count(s, {"Level": ["INFO"], "Template": ["a", "b"]}) == 4
    near = [r["LineID"] for r in browse.page(s, 1, 2, {"Level": ["INFO"]}).collect()]
    assert near == [3, 4]
    assert [r["LineID"] for r in browse.page(s, 3, -1, {"Level": ["INFO"]}).collect()] == [5, 7]
    assert [r["LineID"] for r in browse.page(s, 2, 10_000).collect()] == [3, 4, 5, 6, 7, 9]
    assert [r["LineID"] for r in browse.next_page(s, 3, 2).collect()] == [4, 5]
    shown = [tuple(r) for r in browse.value_histogram(s, "Level", "in", {"Level": ["WARN"]}).collect()]
    assert shown == [("INFO", 5)]
    assert browse.value_histogram(s, "Level", "in", ignore_case=False).collect() == []
    assert [r["Level"] for r in browse.value_histogram(s, "Level").collect()] == ["INFO", None, "ERROR", "WARN"]


def test_template_clusters_separate_unlike_texts(spark):
    texts = [f"alpha beta gamma delta <#*#> one{i % 2}" for i in range(8)] + [f"red green blue black <#*#> two{i % 2}" for i in range(8)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "template_id long, Template string, Count long")
    got = {r["template_id"]: r for r in embedding.cluster_templates(rows, eps=1.2, min_points=4).collect()}
    assert len(got) == 16
    first, second = {got[i]["cluster"] for i in range(8)}, {got[i]["cluster"] for i in range(8, 16)}
    assert len(first) == len(second) == 1 and first != second and -1 not in first | second


def test_roll_ups_equal_single_widths(spark, s):
    fine = analytics.finest_counts(s)
    logs, levels, templates = analytics.log_roll_up(fine), analytics.level_roll_up(fine), analytics.template_roll_up(fine)
    near = analytics.template_roll_up(fine, ["1 day"], approximate=True)
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    for width in ("1 second", "10 minutes", "1 day", "1 week", "1 month"):
        own = f"width = '{width}'"
        assert rows(logs.where(own), "bucket", "Count") == rows(analytics.log_frequency(s, width), "bucket", "Count")
        assert rows(levels.where(own), "Level", "bucket", "Count") == rows(analytics.level_frequency(s, width), "Level", "bucket", "Count")
        assert rows(templates.where(own), "bucket", "Count") == rows(analytics.template_frequency(s, width), "bucket", "Count")
    assert rows(near, "bucket", "Count") == rows(analytics.template_frequency(s, "1 day"), "bucket", "Count")  # few templates: exact


def test_deep_pages_read_few_ranges(spark, tmp_path):
    """A table ordered by line number: a page anywhere reads a hundredth of it at most."""
    path = str(tmp_path / "lines")
    made = spark.range(0, 400_000, 2).selectExpr("id as LineID", "if(id % 10 = 0, 'A', 'B') as Level", "concat('text of ', id) as Content")
    made.coalesce(1).sortWithinPartitions("LineID").write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 8 << 10).parquet(path)
    table = spark.read.parquet(path)
    pages, half = browse.Pages(table), browse.Pages(table, {"Level": ["A"]}, ranges=1000)
    assert pages.total == 200_000 and half.total == 40_000
    for offset in (0, 1, 99_999, 150_000, 199_990):
        assert [r.LineID for r in pages.page(offset, 25).collect()] == [2 * i for i in range(offset, min(offset + 25, 200_000))]
        assert [r.LineID for r in browse.page(table, offset, 3).collect()] == [2 * i for i in range(offset, min(offset + 3, 200_000))]
    assert [r.LineID for r in half.page(20_000, 3).collect()] == [200_000, 200_010, 200_020]
    assert [r.LineID for r in half.page(39_998, -1).collect()] == [399_980, 399_990]
    assert pages.page(200_000, 5).count() == 0 and pages.page(5, 0).count() == 0 and browse.Pages(table.where("LineID < 0")).page(0, 5).count() == 0
    plan = pages.page(150_000, 25)
    text = plan._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(LineID" in text and "LessThan(LineID" in text  # the bounds reach the scan
    inside = table.where((F.col("LineID") >= pages.bounds[12_000]) & (F.col("LineID") < pages.bounds[12_003])).count()
    assert inside < 0.01 * pages.total
