import pytest
from pyspark.sql import functions as F

from logweave.plans.config import FormatConfig, as_table, check_parameters, from_json, to_json
from logweave.plans.presets import PRESETS
from logweave.plans.store import LogStore
from logweave.sources import registry as reg
from logweave.sources import versions
from logweave.sources.versions import Conflict, VersionedTable


def test_store_round_trip(spark, tmp_path):
    log = tmp_path / "App.log"
    log.write_text("10:00:00 INFO: start 1\n10:00:01 INFO: start 2\n10:00:02 WARN: stop\n")
    config = FormatConfig("App", "{Time} {Level}: {Content}", ("Time",), "%H:%M:%S")
    store = LogStore(spark, "log_a")
    assert store.add([str(log), "/x/other.TXT", str(log)]) == [0, 0, -1]
    assert store.add(["/x/other.TXT"]) == [-1]
    assert [r["id"] for r in store.logs().orderBy("id").collect()] == [1, 2]
    assert store.extract(1, config, "AEL", cluster_thr=1) == 3
    row = store.extracted_logs().collect()
    assert [tuple(r) for r in row] == [(1, str(log), "s_1", "t_1")]
    shown = store.logs().where("id = 1").first()
    assert (shown["format_type"], shown["extract_method"], shown["line_count"]) == ("App", "AEL", 3)
    assert store.table_exists("s_1") and store.has_column("s_1", "Level") and not store.has_column("t_1", "Level")
    assert store.columns("t_1") == ["template_id", "Template", "Count"]
    assert store.row_count("t_1") == store.templates(1).count() == 2
    store.delete(1)
    assert not store.table_exists("s_1") and not store.table_exists("t_1")
    store.delete(2)
    assert store.add([str(log)]) == [0]
    assert [r["id"] for r in store.logs().collect()] == [3]  # ids are never given twice
    with pytest.raises(ValueError):
        store.extract(1, config)
    with pytest.raises(ValueError):
        store.update(3, "log_path", "/y")
    with pytest.raises(ValueError):
        store.update(3, "line_count", "many")


def test_two_writers_and_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "registry")
    one, two = LogStore(spark, path=path), LogStore(spark, path=path)
    assert one.add(["/a", "/b"]) == [0, 0] and two.add(["/b", "/c"]) == [-1, 0]
    base = one.registry.version()
    row = one.registry.read().where("id = 1")
    assert two.registry.commit(row.withColumn("extract_method", F.lit("two")), base) == base + 1
    with pytest.raises(Conflict):
        one.registry.commit(row.withColumn("extract_method", F.lit("one")), base)
    assert one.logs().where("id = 1").first()["extract_method"] == "two"
    # a change that meets another writer is made again from what that one left
    met = []

    def slow(registry):
        if not met:
            met.append(two.update(2, "line_count", 5))
        return reg.update_log(registry, 2, "format_type", "X").where("id = 2")

    one.registry.change(slow)
    shown = two.logs().where("id = 2").first()
    assert (shown["line_count"], shown["format_type"]) == (5, "X")
    # a writer that dies before its commit leaves the table as it was, and its version to others
    before = sorted(map(tuple, one.logs().collect()))
    monkeypatch.setattr(VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        one.delete(1)
    monkeypatch.undo()
    assert sorted(map(tuple, two.logs().collect())) == before
    two.delete(1)
    assert [r["id"] for r in one.logs().orderBy("id").collect()] == [2, 3]


def test_versions_are_compacted_and_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "COMPACT", 3)
    table = VersionedTable(spark, str(tmp_path / "t"), "id long, v int")
    assert table.version() == 0 and table.read().count() == 0
    for i in range(7):
        table.change(lambda _, i=i: spark.createDataFrame([(i % 3, i)], "id long, v int"))
    assert sorted(map(tuple, table.read().collect())) == [(0, 6), (1, 4), (2, 5)]
    assert sorted(map(tuple, table.read(2).collect())) == [(0, 0), (1, 1)]
    assert [c[1] for c in table._commits()].count("full") == 3  # behind versions 3, 6 and 9


def test_several_logs_in_one_extraction(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"10:00:0{i} INFO: step {i} of job{k}\n" for i in range(2 + k)))
    config = FormatConfig("App", "{Time} {Level}: {Content}", ("Time",), "%H:%M:%S")
    store = LogStore(spark, path=str(tmp_path / "registry"))
    store.add([str(tmp_path / f"{k}.log") for k in range(3)])
    version = store.registry.version()
    assert store.extract_many([1, 3], config, "Drain") == {1: 2, 3: 4}
    assert store.registry.version() == version + 1
    assert [(r["id"], r["log_path"][-5:]) for r in store.extracted_logs().orderBy("id").collect()] == [(1, "0.log"), (3, "2.log")]
    assert sorted(r["Template"] for r in store.templates(3).collect()) == [f"step {i} of job2" for i in range(4)] and "source_path" not in store.columns("s_3")
    with pytest.raises(ValueError):
        store.extract_many([1, 9], config)


def test_registry_order_and_search(spark):
    rows = [(1, "B", "/a/One.log", None, True, "", 1, False), (2, None, "/a/two.LOG", None, False, "", 5, False),
            (3, "A", "/one/three.log", None, False, "", 3, False)]
    shown = reg.with_status(reg.logs(spark.createDataFrame(rows, reg.STORED)))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(reg.sort_logs(shown, "format_type")) == [3, 1, 2]
    assert ids(reg.sort_logs(shown, "format_type", descending=True)) == [2, 1, 3]
    assert ids(reg.sort_logs(shown, "status")) == [1, 2, 3]
    assert ids(reg.search_logs(shown, " ONE ")) == [1]
    assert [r["status"] for r in reg.sort_logs(shown, "id").collect()] == ["EXTRACTED", "NOT_EXTRACTED", "NOT_EXTRACTED"]


def test_configs_survive_json_and_become_a_table(spark):
    assert from_json(to_json(PRESETS.values())) == list(PRESETS.values())
    rows = as_table(spark, PRESETS.values())
    assert rows.count() == 16
    android = rows.where("name = 'Android'").first()
    assert android["ex_args"]["Spell"] == {"sim_thr": 0.95} and android["user_masks"] == [[r"(/[\w-]+)+", "<#PATH#>"]]


@pytest.mark.parametrize("change", [
    dict(name=" "), dict(log_format=""), dict(timestamp_format=""), dict(timestamp_fields=()),
    dict(timestamp_fields=("Other",)), dict(log_format="{Time} {Text}"), dict(delimiters="é"),
    dict(user_masks=(("(", "x"),)), dict(user_masks=(("a",),)), dict(user_masks=(("é", "x"),)),
])
def test_config_checks(change):
    good = dict(name="x", log_format="{Time} {Content}", timestamp_fields=("Time",), timestamp_format="%H")
    FormatConfig(**good)
    with pytest.raises(ValueError):
        FormatConfig(**{**good, **change})


def test_parameter_checks():
    assert check_parameters("Drain", {"depth": 3}) == {"depth": 3, "children": 100, "sim_thr": 0.4}
    for miner, params in (("Drain", {"depth": 2}), ("Spell", {"sim_thr": 1.1}), ("Brain", {"x": 1}), ("None", {})):
        with pytest.raises(ValueError):
            check_parameters(miner, params)
