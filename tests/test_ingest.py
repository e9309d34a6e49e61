import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions import timing
from logweave.plans.config import FormatConfig
from logweave.plans.extract import extract, extract_file, extract_files
from logweave.plans.presets import PRESETS
from logweave.sources.fields import LineFormat, parse_lines
from logweave.sources.lines import read_log_lines


def parsed(spark, preset, *raw):
    p = PRESETS[preset]
    lines = spark.createDataFrame(list(enumerate(raw, 1)), "LineID long, raw string")
    out = parse_lines(lines, p.log_format, p.timestamp_fields, p.timestamp_format)
    rows = out.withColumn("Timestamp", F.col("Timestamp").cast("string")).orderBy("LineID").collect()
    return [{k: v for k, v in r.asDict().items() if k not in ("raw", "LineID")} for r in rows]


# preset, line, timestamp, some of the other fields
GOLDENS = [
    ("Android", "03-17 16:13:38.811  1702  2395 D Wm: printFreezing", "1900-03-17 16:13:39",
     {"Pid": "1702", "Tid": "2395", "Level": "D", "Component": "Wm", "Content": "printFreezing"}),
    ("Apache", "[Sun Dec 04 04:47:44 2005] [notice] workerEnv.init() ok", "2005-12-04 04:47:44",
     {"Level": "notice", "Content": "workerEnv.init() ok"}),
    ("BGL", "- 1117838570 2005.06.03 R02 2005-06-03-15.42 R02 RAS KERNEL INFO cache parity", "2005-06-03 22:42:50",
     {"Label": "-", "Node": "R02", "NodeRepeat": "R02", "Type": "RAS", "Content": "cache parity"}),
    ("HDFS", "081109 203615 148 INFO dfs.DataNode: PacketResponder 1", "2008-11-09 20:36:15",
     {"Pid": "148", "Component": "dfs.DataNode", "Content": "PacketResponder 1"}),
    ("HPC", "134681 node-246 unix.hw state_change.unavailable 1077804742 1 Component State", "2004-02-26 14:12:22",
     {"LogId": "134681", "Flag": "1", "Content": "Component State"}),
    ("Hadoop", "2015-10-18 18:01:47,978 INFO [main] org.apache.X: Created", "2015-10-18 18:01:48",
     {"Process": "main", "Component": "org.apache.X", "Content": "Created"}),
    ("HealthApp", "20171223-22:15:29:606|Step_LSC|30002312|onStandStepChanged 3579", "2017-12-23 22:15:30",
     {"Component": "Step_LSC", "Pid": "30002312"}),
    ("HealthApp", "20171224-0:5:9:6|A|1|x", "2017-12-24 00:05:10", {"Content": "x"}),
    ("Linux", "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure", "1900-06-14 15:16:01",
     {"Level": "combo", "Component": "sshd(pam_unix)[19939]"}),
    ("Linux", "Jun  9 06:06:20 combo syslogd: restart", "1900-06-09 06:06:20", {"Content": "restart"}),
    ("Mac", "Jul  1 09:00:55 calvisitor kernel[0]: IOThunder", "1900-07-01 09:00:55",
     {"User": "calvisitor", "Component": "kernel[0]"}),
    ("OpenSSH", "Dec 10 06:55:46 LabSZ sshd[24200]: reverse mapping", "1900-12-10 06:55:46",
     {"Component": "LabSZ", "Pid": "24200"}),
    ("OpenStack", "nova.log 2017-05-16 00:00:00.008 25746 INFO nova.osapi [req-38] 10.11 GET", "2017-05-16 00:00:00",
     {"Logrecord": "nova.log", "ADDR": "req-38", "Content": "10.11 GET"}),
    ("Proxifier", "[10.30 16:49:06] chrome.exe - proxy open", "1900-10-30 16:49:06",
     {"Program": "chrome.exe", "Content": "proxy open"}),
    ("Spark", "17/06/09 20:10:40 INFO executor.Backend: Registered", "2017-06-09 20:10:40",
     {"Level": "INFO", "Component": "executor.Backend"}),
    ("Thunderbird", "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam)[2915]: session closed",
     "2005-11-09 20:01:01", {"User": "dn228", "Location": "dn228/dn228", "Content": "session closed"}),
    ("Windows", "2016-09-28 04:30:30, Info                  CBS    Loaded Servicing", "2016-09-28 04:30:30",
     {"Level": "Info", "Component": "CBS", "Content": "Loaded Servicing"}),
    ("Zookeeper", "2015-07-29 17:41:44,747 - INFO  [QuorumPeer:Fast@774] - Notification", "2015-07-29 17:41:45",
     {"Level": "INFO", "Node": "QuorumPeer", "Component": "Fast", "Id": "774"}),
]


@pytest.mark.parametrize("preset,line,ts,fields", GOLDENS)
def test_preset_line(spark, preset, line, ts, fields):
    good, blank, bad = parsed(spark, preset, line, None, "no such line")
    assert good["Timestamp"] == ts and good["reason"] is None
    assert {k: good[k] for k in fields} == fields
    assert blank["reason"] is None and blank["Timestamp"] is None and blank["Content"] is None
    assert bad["reason"] == "line format"


def test_every_preset_has_a_golden():
    assert {g[0] for g in GOLDENS} == set(PRESETS)


def test_format_errors():
    for text in ("no fields", "{A} {A}", "{A:d}", "{A"):
        with pytest.raises(ValueError):
            LineFormat.compile(text)


def test_separator_and_carriage_return(spark):
    good, odd = parsed(spark, "Spark", "17/06/09 20:10:40 INFO a.B: x\r", "17/06/09 20:10:40 INFO a.B: x\u0001y")
    assert good["Content"] == "x\r" and odd["reason"] == "line format"


@pytest.mark.parametrize("text,fmt,expected", [
    ("Jun 9 6:6:2", "%b %d %H:%M:%S", "1900-06-09 06:06:02"),
    (" jun 9 6:6:2 ", "%b %d %H:%M:%S", "1900-06-09 06:06:02"),
    ("June 9 6:6:2", "%b %d %H:%M:%S", None),
    ("Feb 29 10:00:00", "%b %d %H:%M:%S", None),
    ("690109 203615", "%y%m%d %H%M%S", "1969-01-09 20:36:15"),
    ("680109 203615", "%y%m%d %H%M%S", "2068-01-09 20:36:15"),
    ("Xxx Dec 04 04:47:44 2005", "%a %b %d %H:%M:%S %Y", None),
    ("2015-07-32 17:41:44,747", "%Y-%m-%d %H:%M:%S,%g", None),
    ("2015-02-09 24:00:00,000", "%Y-%m-%d %H:%M:%S,%g", None),
    ("2015-02-09 23:59:60,000", "%Y-%m-%d %H:%M:%S,%g", None),
    ("2015-12-31 23:59:59,500", "%Y-%m-%d %H:%M:%S,%g", "2016-01-01 00:00:00"),
    ("2015-12-31 23:59:59,499", "%Y-%m-%d %H:%M:%S,%g", "2015-12-31 23:59:59"),
])
def test_parse_timestamp(spark, text, fmt, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(timing.parse_timestamp(F.col("t"), fmt).cast("string")).first()[0] == expected


def test_time_results_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 07:30:00",)], "t string")
        ts = timing.parse_timestamp(F.col("t"), "%Y-%m-%d %H:%M:%S")
        row = df.select(
            timing.epoch_seconds(ts), timing.bucket_seconds(ts, "1 day"), timing.bucket_seconds(ts, "1 month")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())
    assert tuple(row) == (utc(2024, 3, 10, 7, 30), utc(2024, 3, 10), utc(2024, 3, 1))


def test_buckets_before_the_origin(spark):
    df = spark.sql("select timestamp'1969-12-31 23:59:59' as t union all select null")
    week = [r[0] for r in df.select(timing.bucket_seconds(F.col("t"), "1 week").alias("b")).orderBy("b").collect()]
    assert week == [None, int(dt.datetime(1969, 12, 29, tzinfo=dt.timezone.utc).timestamp())]


def test_width_errors():
    for bad in ((1, 1, 0), (0, 0, 0), (-1, 0, 0)):
        with pytest.raises(ValueError):
            timing.Width(*bad)
    with pytest.raises(ValueError):
        timing.Width.of("2 fortnights")


def test_numbering_over_many_splits(spark, tmp_path):
    first = [f"line {i} " + "x" * (i % 40) if i % 9 else "" for i in range(5000)]
    second = ["only\r", "", "three"]
    (tmp_path / "a.log").write_bytes("\n".join(first).encode() + b"\n")
    (tmp_path / "b.log").write_bytes("\n".join(second).encode())
    (tmp_path / "c.log").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = read_log_lines(spark, [str(tmp_path / n) for n in ("a.log", "b.log", "c.log")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in rows:
        by_file.setdefault(r["source_path"][-5:], {})[r["LineID"]] = r["raw"]
    assert by_file["a.log"] == {i + 1: (t or None) for i, t in enumerate(first)}
    assert by_file["b.log"] == {1: "only\r", 2: None, 3: "three"}
    assert set(by_file) == {"a.log", "b.log"}


CONFIG = FormatConfig("Tiny", "{Time} {Level}: {Content}", ("Time",), "%H:%M:%S", ((r"\d+", "<#N#>"),), "=")


def test_extract_file(spark, tmp_path):
    path = tmp_path / "t.log"
    path.write_text("10:00:00 INFO: a=1 b\n\n10:00:01 WARN: a=2 b\n10:00:02 INFO: other\n")
    result = extract_file(spark, str(path), CONFIG, miner="AEL")
    assert result.structured.columns == ["LineID", "Timestamp", "Level", "Content", "Template"]
    got = [(r["LineID"], r["Level"], r["Template"]) for r in result.structured.orderBy("LineID").collect()]
    assert got == [(1, "INFO", "a= <#N#> b"), (2, None, None), (3, "WARN", "a= <#N#> b"), (4, "INFO", "other")]
    assert [tuple(r) for r in result.templates.orderBy("template_id").collect()] == [
        (0, "a= <#N#> b", 2), (1, "other", 1)
    ]


def test_bad_lines_fail_or_are_set_aside(spark):
    raw = [(1, "10:00:00 INFO: x"), (2, "nonsense"), (3, "99:00:00 INFO: x")]
    lines = spark.createDataFrame(raw, "LineID long, raw string")
    with pytest.raises(Exception, match="does not fit the"):
        extract(lines, CONFIG)
    result = extract(lines, CONFIG, on_bad="quarantine")
    assert [r["LineID"] for r in result.structured.collect()] == [1]
    bad = [(r["LineID"], r["reason"]) for r in result.bad_lines.orderBy("LineID").collect()]
    assert bad == [(2, "line format"), (3, "timestamp format")]


def test_masks_and_tuning_options(spark):
    lines = spark.createDataFrame([(1, "10:00:00 INFO: from 10.0.0.1:80 x")], "LineID long, raw string")
    config = FormatConfig("IP", "{Time} {Level}: {Content}", ("Time",), "%H:%M:%S", ex_args={"Brain": {"var_thr": 7}})
    full = extract(lines, config, "Brain").structured.first()["Template"]
    user = extract(lines, config, "Brain", masks="user").structured.first()["Template"]
    assert (full, user) == ("from <#IP#> x", "from 10.0.0.1:80 x")
    assert config.parameters("Brain") == {"var_thr": 7}
    assert config.parameters("Brain", tuned=False) == {"var_thr": 2}


def test_a_line_without_its_separator_is_refused_at_once(spark):
    import time

    preset = PRESETS["Thunderbird"]
    lines = spark.createDataFrame([(i, " ".join(["tok"] * (150 + i))) for i in range(20)], "LineID long, raw string")
    start = time.time()
    parsed = parse_lines(lines, preset.log_format, preset.timestamp_fields, preset.timestamp_format)
    assert {r["reason"] for r in parsed.collect()} == {"line format"} and time.time() - start < 60


def test_reserved_field_names_and_named_groups():
    with pytest.raises(ValueError, match="extraction itself"):
        FormatConfig("x", "{Date} {Raw} {Content}", ["Date"], "%Y-%m-%d")
    config = FormatConfig("x", "{Date} {Content}", ["Date"], "%Y-%m-%d", [[r"(?P<A>a+)(?<!b)", "<#A#>"]])
    assert config.user_masks[0][0] == "(?<A>a+)(?<!b)"


def test_several_files_are_several_logs(spark, tmp_path):
    for name, words in (("a", "one two"), ("b", "six ten")):
        (tmp_path / f"{name}.log").write_text("".join(f"2024-01-0{i} {words} {i}\n" for i in range(1, 5)))
    config = FormatConfig("x", "{Date} {Content}", ["Date"], "%Y-%m-%d")
    with pytest.raises(ValueError, match="several files"):
        extract_file(spark, str(tmp_path), config)
    for miner in ("Brain", "Spell"):
        out = extract_files(spark, str(tmp_path), config, miner=miner)
        rows = out.structured.collect()
        assert len(rows) == 8 and {(r.source_path[-5:], r.LineID) for r in rows} == {(f, i) for f in ("a.log", "b.log") for i in range(1, 5)}
        assert all(("one" in r.Template) == r.source_path.endswith("a.log") for r in rows)
