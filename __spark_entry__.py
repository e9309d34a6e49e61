"""Queries over the given tables and, where SQL can state them, the same in SQL.

Most queries work on a log derived from ``events``: one line per event with a timestamp, a level, a
component and free text.
"""

from __future__ import annotations

import functools
import importlib
import re
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logweave.functions import text, timing  # noqa: E402
from logweave.operators.density import density_clusters, neighbour_counts  # noqa: E402
from logweave.operators.sequence import with_next, with_rank  # noqa: E402
from logweave.plans import analytics, browse, embedding  # noqa: E402
from logweave.plans.config import BUILTIN_MASKS, FormatConfig  # noqa: E402
from logweave.plans.extract import extract_files, mine, prepare, template_table  # noqa: E402
from logweave.plans.presets import PRESETS  # noqa: E402
from logweave.session import materialize, shared_dir, ship  # noqa: E402
from logweave.sources import registry as reg  # noqa: E402
from logweave.sources.fields import parse_lines  # noqa: E402
from logweave.sources.lines import read_log_lines  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


# --- the derived log -----------------------------------------------------------------------------

_CONTENT = """concat('user ', cast(user_id as {s}), ' ', event_type,
  case when event_id % 3 = 0 then ' from 10.0.0.' else ' via node-' end,
  cast(user_id % 50 as {s}), ' k=', regexp_extract(props, '([0-9]+)', 1), ' ok')"""

_LOG = """select event_id + 1 as LineID, date_trunc('second', ts) as Timestamp, upper(event_type) as Level,
  concat('svc', cast(user_id % 7 as {s})) as Component, """ + _CONTENT + """ as Content"""

LOG_SQL = "log as (" + _LOG.format(s="varchar") + " from events)"

# masks that leave the shape of the text, so that the masked text can serve as a template
SHAPE_MASKS = ((r"user \d+", "user <#*#>"), (r"k=\d+", "k=<#*#>"))
_SHAPE_SQL = r"regexp_replace(regexp_replace(Content, 'user \d+', 'user <#*#>', 'g'), 'k=\d+', 'k=<#*#>', 'g')"
STRUCTURED_SQL = LOG_SQL + f", s as (select LineID, Timestamp, Level, Component, {_SHAPE_SQL} as Template from log)"
TEMPLATES_SQL = """t as (select Template, count(*) as Count,
  row_number() over (order by count(*) desc, Template) - 1 as template_id
  from s where Template is not null group by Template)"""
MATRIX_SQL = f"with {STRUCTURED_SQL}, {TEMPLATES_SQL}"

DELIMITERS = "="
_MASKED_SQL = r"regexp_replace(Content, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{0,})?', '<#IP#>', 'g')"
PREPARED_SQL = (
    LOG_SQL
    + f", m as (select *, {_MASKED_SQL} as MaskedContent from log)"
    + ", p as (select *, replace(MaskedContent, '=', '= ') as PaddedContent from m)"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "events")
    return source.select(
        (F.col("event_id") + 1).alias("LineID"),
        F.date_trunc("second", F.col("ts")).alias("Timestamp"),
        F.upper("event_type").alias("Level"),
        F.expr("concat('svc', cast(user_id % 7 as string))").alias("Component"),
        F.expr(_CONTENT.format(s="string")).alias("Content"),
    )


def structured(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).withColumn("Template", text.mask(F.col("Content"), SHAPE_MASKS)).drop("Content")


def seconds(name: str):
    return timing.epoch_seconds(F.col(name))


# --- ingest --------------------------------------------------------------------------------------


@query(
    "log_view",
    f"with {LOG_SQL} select LineID, epoch(Timestamp)::bigint as ts, Level, Component, Content from log",
)
def log_view(spark, sf):
    return log(spark, sf).withColumn("ts", seconds("Timestamp")).drop("Timestamp")


_RAW_FORMAT = "{Date} {Time} {Level} {EventId} [{Component}]: {Content}"
_RAW = """concat_ws(' ', {day}, upper(event_type), cast(event_id as {s}),
  concat('[svc', cast(user_id % 7 as {s}), ']:'), """ + _CONTENT + ")"


def raw_lines(spark, sf):
    day = "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')"
    return table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("LineID"), F.expr(_RAW.format(s="string", day=day)).alias("raw")
    )


_RAW_SQL = "raw as (select event_id + 1 as LineID, " + _RAW.format(
    s="varchar", day="strftime(ts, '%Y-%m-%d %H:%M:%S,%g')"
) + " as raw from events)"


def regex_sql(log_format: str) -> str:
    """The expression of a line format, written out from its rules, without those of the engine."""
    fields = {"": "(.+?)", "<": "(.+?) *", ">": " *(.+?)", "^": " *(.+?) *"}
    parts = re.split(r"\{\w+:?([<>^]?)\}", log_format)  # literals, and between them how fields are aligned
    return "^" + "".join(fields[p] if i % 2 else re.sub(r"([^\w ,:/-])", r"\\\1", p) for i, p in enumerate(parts)) + "$"


@query(
    "field_extraction",
    f"""with {_RAW_SQL}, cap as (
      select LineID, unnest(regexp_extract(raw, '{regex_sql(_RAW_FORMAT)}',
        ['Date', 'Time', 'Level', 'EventId', 'Component', 'Content'])) from raw)
    select LineID, epoch(cast(strptime(concat_ws(' ', Date, Time), '%Y-%m-%d %H:%M:%S,%g') as timestamp_s))::bigint
      as ts, Level, EventId, Component, Content from cap""",
)
def field_extraction(spark, sf):
    parsed = parse_lines(raw_lines(spark, sf), _RAW_FORMAT, ("Date", "Time"), "%Y-%m-%d %H:%M:%S,%g")
    return parsed.select("LineID", seconds("Timestamp").alias("ts"), "Level", "EventId", "Component", "Content")


@query(
    "bad_lines",
    f"""with {_RAW_SQL}, d as (
      select LineID, case when LineID % 10 = 0 then replace(raw, '[svc', 'svc')
        when LineID % 10 = 1 then replace(raw, '2024-', '20x4-') when LineID % 10 = 2 then null else raw end as raw
      from raw)
    select LineID, raw, case when LineID % 10 = 0 then 'line format' else 'timestamp format' end as reason
    from d where LineID % 10 < 2""",
)
def bad_lines(spark, sf):
    last = F.col("LineID") % 10
    damaged = raw_lines(spark, sf).withColumn(
        "raw",
        F.when(last == 0, F.replace("raw", F.lit("[svc"), F.lit("svc")))
        .when(last == 1, F.replace("raw", F.lit("2024-"), F.lit("20x4-")))
        .when(last == 2, F.lit(None))
        .otherwise(F.col("raw")),
    )
    parsed = parse_lines(damaged, _RAW_FORMAT, ("Date", "Time"), "%Y-%m-%d %H:%M:%S,%g")
    return parsed.where(F.col("reason").isNotNull()).select("LineID", "raw", "reason")


@query(
    "text_ingest",
    "with " + LOG_SQL + """
    select LineID - 1 as event, Level, Content, LineID as position from log""",
)
def text_ingest(spark, sf):
    """Write the log as text files, read them back as numbered lines and put the files in order again."""
    folder = write_text(raw_lines(spark, sf))
    lines = read_log_lines(spark, folder)
    parsed = parse_lines(lines, _RAW_FORMAT, ("Date", "Time"), "%Y-%m-%d %H:%M:%S,%g").withColumn(
        "event", F.col("EventId").cast("long")
    )
    starts = parsed.groupBy("source_path").agg(F.min("event").alias("start"))
    return parsed.join(starts, "source_path").select(
        "event", "Level", "Content", (F.col("start") + F.col("LineID")).alias("position")
    )


def write_text(lines: DataFrame) -> str:
    folder = f"{shared_dir(lines.sparkSession)}/text-{uuid.uuid4().hex}"
    lines.repartitionByRange("LineID").sortWithinPartitions("LineID").select("raw").write.text(folder)
    return folder


# every preset, on lines rendered in its format

_JAVA_TIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "g": "SSS", "b": "MMM", "a": "EEE",
    "-H": "H", "-M": "m", "-S": "s",
}


def _rendered(preset, sql: bool) -> str:
    """An SQL expression that writes an event as a line of the preset, for Spark or for the checker."""
    s = "varchar" if sql else "string"
    fields = {
        "Level": "upper(event_type)",
        "Component": f"concat('svc', cast(user_id % 7 as {s}))",
        "Pid": f"cast(user_id as {s})",
        "Tid": f"cast(event_id as {s})",
        "Content": _CONTENT.format(s=s),
    }
    first, *others = preset.timestamp_fields
    if preset.timestamp_format == "epoch":
        fields[first] = f"cast(cast(floor(epoch(ts)) as bigint) as {s})" if sql else f"cast(unix_timestamp(ts) as {s})"
        fields.update({f: "'2024.01.01'" for f in others})
    else:
        fmt = preset.timestamp_format.replace("%c", "%Y-%m-%d %H:%M:%S")
        parts = fmt.split(" ") if others else [fmt]
        for name, part in zip(preset.timestamp_fields, parts):
            if sql:
                fields[name] = f"strftime(ts, '{part}')"
            else:
                java = re.sub(r"%(-?[A-Za-z])", lambda m: _JAVA_TIME[m.group(1)], part)
                fields[name] = f"date_format(ts, '{java}')"
    pieces, end = [], 0
    for m in re.finditer(r"\{(\w+)(?::[<>^])?\}", preset.log_format):
        pieces.append("'" + preset.log_format[end : m.start()] + "'")
        pieces.append(fields.get(m.group(1), "'x'"))
        end = m.end()
    pieces.append("'" + preset.log_format[end:] + "'")
    return "concat(" + ", ".join(pieces) + ")"


def _preset_sql(preset) -> str:
    names = re.findall(r"\{(\w+)", preset.log_format)
    if preset.timestamp_format == "epoch":
        ts = f"{preset.timestamp_fields[0]}::bigint"
    else:
        joined = "concat_ws(' ', " + ", ".join(f"c.{f}" for f in preset.timestamp_fields) + ")"
        ts = f"epoch(cast(strptime({joined}, '{preset.timestamp_format}') as timestamp_s))::bigint"
    renamed = ", ".join(f"'{n}'" for n in names)
    return f"""select '{preset.name}' as preset, LineID, {ts.replace("c.", "cap.")} as ts, cap.Content as Content
      from (select event_id + 1 as LineID,
        regexp_extract({_rendered(preset, True)}, '{regex_sql(preset.log_format)}', [{renamed}]) as cap from events)"""


def _preset_ts_sql(preset) -> str:
    return _preset_sql(preset).replace(
        f"{preset.timestamp_fields[0]}::bigint", f"cap.{preset.timestamp_fields[0]}::bigint"
    )


@query("preset_lines", " union all ".join(_preset_ts_sql(p) for p in PRESETS.values()))
def preset_lines(spark, sf):
    source = table(spark, sf, "events")
    result = None
    for preset in PRESETS.values():
        raw = source.select((F.col("event_id") + 1).alias("LineID"), F.expr(_rendered(preset, False)).alias("raw"))
        parsed = parse_lines(raw, preset.log_format, preset.timestamp_fields, preset.timestamp_format)
        part = parsed.select(F.lit(preset.name).alias("preset"), "LineID", seconds("Timestamp").alias("ts"), "Content")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "epoch_timestamps",
    """select o_orderkey, epoch(cast(make_timestamp_ms(
         cast(cast(o_totalprice * 10000 as bigint) as bigint) * 1000) as timestamp_s))::bigint as ts
       from orders""",
)
def epoch_timestamps(spark, sf):
    field = (F.col("o_totalprice") * 10000).cast("decimal(20,0)").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", timing.epoch_seconds(timing.epoch_timestamp(field)).alias("ts")
    )


@query(
    "rounded_seconds",
    "select event_id, epoch(cast(ts as timestamp_s))::bigint as ts from events",
)
def rounded_seconds(spark, sf):
    micros = timing.epoch_micros(F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", timing.epoch_seconds(timing.round_to_second(micros)).alias("ts")
    )


# --- masks and tokens ----------------------------------------------------------------------------


@query("masked_content", f"with {PREPARED_SQL} select LineID, MaskedContent, PaddedContent from p")
def masked_content(spark, sf):
    return prepare(log(spark, sf), BUILTIN_MASKS, DELIMITERS).select("LineID", "MaskedContent", "PaddedContent")


@query(
    "document_masks",
    r"""select doc_id, regexp_replace(regexp_replace(text,
          '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{0,})?', '<#IP#>', 'g'), '[0-9]+', '<#NUM#>', 'g') as MaskedContent
        from documents""",
)
def document_masks(spark, sf):
    masks = [*BUILTIN_MASKS, ("[0-9]+", "<#NUM#>")]
    return table(spark, sf, "documents").select("doc_id", text.mask(F.col("text"), masks).alias("MaskedContent"))


@query(
    "tokens",
    f"""with {PREPARED_SQL}, k as (select LineID, MaskedContent, str_split(PaddedContent, ' ') as Tokens from p)
    select LineID, len(Tokens) as token_count, len(regexp_extract_all(MaskedContent, '<#.*#>')) as para_count,
      array_to_string(Tokens, '|') as joined, array_to_string(Tokens, ' ') as template from k""",
)
def tokens(spark, sf):
    prepared = prepare(log(spark, sf), BUILTIN_MASKS, DELIMITERS)
    split = prepared.withColumn("Tokens", text.tokenize(F.col("PaddedContent")))
    return split.select(
        "LineID",
        text.token_count(F.col("Tokens")).alias("token_count"),
        text.parameter_count(F.col("MaskedContent")).alias("para_count"),
        F.array_join("Tokens", "|").alias("joined"),
        text.template_text(F.col("Tokens")).alias("template"),
    )


@query(
    "text_presentation",
    """select coalesce(cast(event_id as varchar), '') as event_id, coalesce(nullif(event_type, 'error'), '') as kind,
         coalesce(cast(case when user_id % 5 > 0 then user_id end as varchar), '') as who from events""",
)
def text_presentation(spark, sf):
    shown = table(spark, sf, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("who"),
    )
    return text.as_text(shown)


# --- time ----------------------------------------------------------------------------------------

_WIDTH_SQL = {
    name: f"interval {months} months" if months else f"interval {days} days" if days else f"interval {us} microseconds"
    for name, (months, days, us) in timing.WIDTHS.items()
}


@query(
    "time_buckets",
    f"with {LOG_SQL} "
    + " union all ".join(
        f"select LineID, '{n}' as width, epoch(time_bucket({w}, Timestamp))::bigint as bucket from log"
        for n, w in _WIDTH_SQL.items()
    ),
)
def time_buckets(spark, sf):
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("width"), timing.bucket_seconds(F.col("Timestamp"), n).alias("bucket"))
            for n in timing.WIDTHS
        ]
    )
    return log(spark, sf).select("LineID", F.explode(cells).alias("cell")).select("LineID", "cell.*")


@query(
    "order_buckets",
    """select o_orderkey, epoch(time_bucket(interval 7 days, o_orderdate))::bigint as week,
         epoch(time_bucket(interval 1 months, o_orderdate))::bigint as month,
         epoch(time_bucket(interval 5 months, o_orderdate))::bigint as five_months from orders""",
)
def order_buckets(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        timing.bucket_seconds(day, "1 week").alias("week"),
        timing.bucket_seconds(day, "1 month").alias("month"),
        timing.bucket_seconds(day, timing.Width(months=5)).alias("five_months"),
    )


@query("level_distribution", f"with {LOG_SQL} select Level, count(*) as Count from log group by Level")
def level_distribution(spark, sf):
    return analytics.level_distribution(log(spark, sf))


def _frequency(width: str):
    w = _WIDTH_SQL[width]
    tag = width.replace(" ", "_")
    bucket = f"epoch(time_bucket({w}, Timestamp))::bigint as bucket"

    @query(f"log_frequency_{tag}", f"with {LOG_SQL} select {bucket}, count(*) as Count from log group by 1")
    def _(spark, sf):
        return analytics.log_frequency(log(spark, sf), width)

    @query(
        f"template_frequency_{tag}",
        f"with {STRUCTURED_SQL} select {bucket}, count(distinct Template) as Count from s group by 1",
    )
    def _(spark, sf):
        return analytics.template_frequency(structured(spark, sf), width)

    @query(
        f"level_frequency_{tag}",
        f"with {LOG_SQL} select Level, {bucket}, count(*) as Count from log group by 1, 2",
    )
    def _(spark, sf):
        return analytics.level_frequency(log(spark, sf), width)


for _width in ("1 minute", "1 hour", "1 day", "1 week", "1 month"):
    _frequency(_width)


def _roll_up_sql(columns: str, count: str, groups: str) -> str:
    """The same query once for each width."""
    one = "select '{name}' as width, {columns}epoch(time_bucket({width}, Timestamp))::bigint as bucket, {count} as Count from s group by {groups}"
    each = [one.format(name=n, columns=columns, width=w, count=count, groups=groups) for n, w in _WIDTH_SQL.items()]
    return f"with {STRUCTURED_SQL} " + " union all ".join(each)


@query("log_roll_up", _roll_up_sql("", "count(*)", "2"))
def log_roll_up(spark, sf):
    return analytics.log_roll_up(analytics.finest_counts(structured(spark, sf)))


@query("level_roll_up", _roll_up_sql("Level, ", "count(*)", "2, 3"))
def level_roll_up(spark, sf):
    return analytics.level_roll_up(analytics.finest_counts(structured(spark, sf)))


@query("template_roll_up", _roll_up_sql("", "count(distinct Template)", "2"))
def template_roll_up(spark, sf):
    return analytics.template_roll_up(analytics.finest_counts(structured(spark, sf)))


@query(
    "log_frequency_null_times",
    f"""with {LOG_SQL}, n as (select case when LineID % 100 <> 0 then Timestamp end as Timestamp from log)
    select epoch(time_bucket(interval 1 days, Timestamp))::bigint as bucket, count(*) as Count from n group by 1""",
)
def log_frequency_null_times(spark, sf):
    gaps = log(spark, sf).withColumn("Timestamp", F.when(F.col("LineID") % 100 != 0, F.col("Timestamp")))
    return analytics.log_frequency(gaps, "1 day")


# --- templates and matrices ----------------------------------------------------------------------


@query(
    "template_table",
    MATRIX_SQL + " select template_id, Template, Count from t",
)
def templates_of_log(spark, sf):
    return template_table(structured(spark, sf))


@query(
    "log_counts",
    MATRIX_SQL + """ select 'lines' as name, count(*) as n from s
    union all select 'templates' as name, count(*) as n from t""",
)
def log_counts(spark, sf):
    s = structured(spark, sf)
    return analytics.log_counts(s, template_table(s))


def _steps_sql(source: str = "s", partition: str = "") -> str:
    return f""", steps as (
      select template_id as i, lead(template_id) over ({partition} order by LineID) as j, Timestamp,
        lead(Timestamp) over ({partition} order by LineID) as next_ts
      from {source} join t using (Template))"""


_TRANSITION_SQL = ", tr as (select i, j, count(*) as value from steps where j is not null group by i, j)"


@query("template_transition", MATRIX_SQL + _steps_sql() + _TRANSITION_SQL + " select * from tr")
def template_transition(spark, sf):
    s = structured(spark, sf)
    return analytics.template_transition(s, template_table(s))


@query(
    "template_transition_gapped",
    MATRIX_SQL
    + ", g as (select * replace (LineID * 3 + LineID % 3 + case when LineID > 3000 then 1000000 else 0 end as LineID) from s)"
    + _steps_sql("g")
    + _TRANSITION_SQL
    + " select * from tr",
)
def template_transition_gapped(spark, sf):
    s = structured(spark, sf)
    gapped = s.withColumn("LineID", F.expr("LineID * 3 + LineID % 3 + if(LineID > 3000, 1000000, 0)"))
    return analytics.template_transition(gapped, template_table(s))


@query(
    "template_transition_by_component",
    MATRIX_SQL + _steps_sql("s", "partition by Component") + _TRANSITION_SQL + " select * from tr",
)
def template_transition_by_component(spark, sf):
    s = structured(spark, sf)
    return analytics.template_transition(s, template_table(s), ["Component"])


@query(
    "next_line",
    f"with {LOG_SQL} select LineID, Level, lead(Level) over (order by LineID) as next_level from log",
)
def next_line(spark, sf):
    rows = with_next(log(spark, sf).select("LineID", "Level"), "LineID", ["Level"], block=1000)
    return rows.select("LineID", "Level", F.col("_next.Level").alias("next_level"))


@query(
    "transition_probability",
    MATRIX_SQL
    + _steps_sql()
    + _TRANSITION_SQL
    + " select i, j, value / sum(value) over (partition by i) as value from tr",
)
def transition_probability(spark, sf):
    return analytics.transition_probability(template_transition(spark, sf))


@query(
    "template_dwell",
    MATRIX_SQL
    + _steps_sql()
    + """ select i, j, cast(trunc(sum(epoch(next_ts)::bigint - epoch(Timestamp)::bigint) / count(*)) as bigint) as value
    from steps where j is not null group by i, j""",
)
def template_dwell(spark, sf):
    s = structured(spark, sf)
    return analytics.template_dwell(s, template_table(s))


def _cooccurrence_sql(width: str, symmetric: bool = False) -> str:
    pairs = f""", d as (
        select distinct time_bucket({_WIDTH_SQL[width]}, Timestamp) as bucket, template_id as id
        from s join t using (Template)),
      co as (select a.id as i, b.id as j, count(*) as value from d a join d b on a.bucket = b.bucket and a.id < b.id
        group by a.id, b.id)"""
    mirrored = " select i, j, value from co"
    if symmetric:
        mirrored += " union all select j as i, i as j, value from co"
    return MATRIX_SQL + pairs + mirrored


def _cooccurrence(width: str):
    @query(f"template_cooccurrence_{width.replace(' ', '_')}", _cooccurrence_sql(width))
    def _(spark, sf):
        s = structured(spark, sf)
        return analytics.template_cooccurrence(s, template_table(s), width)


for _width in ("1 minute", "6 hours", "1 week"):
    _cooccurrence(_width)


@query("template_cooccurrence_symmetric", _cooccurrence_sql("1 hour", symmetric=True))
def template_cooccurrence_symmetric(spark, sf):
    s = structured(spark, sf)
    return analytics.template_cooccurrence(s, template_table(s), "1 hour", symmetric=True, tile=128)


_BY_LEVEL_SQL = (
    f"with {LOG_SQL}, s as (select LineID, Timestamp, Level as Template from log), {TEMPLATES_SQL}"
    + _steps_sql()
    + _TRANSITION_SQL
)


@query(
    "dense_transition",
    _BY_LEVEL_SQL
    + """ select ids.i, array_to_string(list(coalesce(value, 0)::bigint order by js.j), ' ') as cells
      from range(5) ids(i) cross join range(5) js(j) left join tr on tr.i = ids.i and tr.j = js.j group by ids.i""",
)
def dense_transition(spark, sf):
    s = log(spark, sf).select("LineID", F.col("Level").alias("Template"))
    t = template_table(s)
    rows = analytics.dense(analytics.template_transition(s, t), t.count())
    return rows.select("i", F.concat_ws(" ", F.col("cells").cast("array<string>")).alias("cells"))


@query(
    "colour_scale",
    MATRIX_SQL
    + _steps_sql()
    + _TRANSITION_SQL
    + """ select quantile_cont(value, 0.99) as p99, max(value) as max, ln(1 + quantile_cont(value, 0.99)) as log_p99,
      ln(1 + max(value)) as log_max from tr where value > 0""",
)
def colour_scale(spark, sf):
    return analytics.colour_scale(template_transition(spark, sf))


# --- miners --------------------------------------------------------------------------------------


def mined(spark, sf, miner, **params):
    lines = log(spark, sf).select("LineID", "Timestamp", "Content")
    return mine(lines, miner, BUILTIN_MASKS, DELIMITERS, **params)


_CONVERSATIONS_SQL = r"""p as (select conv_id * 100000 + turn as LineID, Content,
  Content as MaskedContent, replace(replace(Content, ',', ', '), '.', '. ') as PaddedContent
  from (select conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') as Content from conversations))"""


def conversation_lines(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("LineID"),
        text.mask(F.col("text"), [(r"\s+", " ")]).alias("Content"),
    )


def _brain_sql(var_thr: int) -> str:
    return f""", lines as (select LineID, PaddedContent, str_split(PaddedContent, ' ') as tokens from p),
    cells as (select LineID, len(tokens) as length, unnest(range(len(tokens))) as col, unnest(tokens) as token from lines),
    freqs as (select length, col, token, count(*) as freq from cells group by all),
    f as (select * from cells join freqs using (length, col, token)),
    hist as (select LineID, length, freq, count(*) as n, max(freq) over (partition by LineID) as top
      from f group by LineID, length, freq),
    roots as (select LineID, arg_max(freq, n * 100000000::hugeint - freq) as root_freq,
        max(n * 100000000::hugeint - freq) as rank, arg_max(n, n * 100000000::hugeint - freq) as root_n
      from hist where freq >= top * 0.5 group by LineID),
    r as (select * from f join roots using (LineID)),
    cols as (select length, root_freq, root_n, col, max(freq) as high, count(distinct token) as words
      from r group by all),
    shown as (select LineID, string_agg(case when (high > root_freq and words > 1)
        or (high < root_freq and words >= {var_thr}) then '<#*#>' else token end, ' ' order by col) as Template
      from r join cols using (length, root_freq, root_n, col) group by LineID)"""


@query("brain", f"with {PREPARED_SQL}" + _brain_sql(2) + " select LineID, Template from shown")
def brain(spark, sf):
    return mined(spark, sf, "Brain").select("LineID", "Template")


@query("brain_tuned", f"with {PREPARED_SQL}" + _brain_sql(10) + " select LineID, Template from shown")
def brain_tuned(spark, sf):
    return mined(spark, sf, "Brain", var_thr=10).select("LineID", "Template")


@query(
    "brain_conversations", f"with {_CONVERSATIONS_SQL}" + _brain_sql(3) + " select LineID, Template from shown"
)
def brain_conversations(spark, sf):
    out = mine(conversation_lines(spark, sf), "Brain", (), ",.", var_thr=3)
    return out.select("LineID", "Template")


@query(
    "brain_transition",
    f"with {PREPARED_SQL}"
    + _brain_sql(10)
    + f", s as (select LineID, Template, null::timestamp as Timestamp from shown), {TEMPLATES_SQL}"
    + _steps_sql()
    + _TRANSITION_SQL
    + " select * from tr",
)
def brain_transition(spark, sf):
    s = materialize(mined(spark, sf, "Brain", var_thr=10))
    return analytics.template_transition(s, template_table(s))


def _ael_sql(cluster_thr: int) -> str:
    return f""", lines as (select LineID, PaddedContent, str_split(PaddedContent, ' ') as tokens,
        len(regexp_extract_all(MaskedContent, '<#.*#>')) as paras from p),
    bins as (select len(tokens) as length, paras, count(distinct PaddedContent) as contents from lines group by 1, 2),
    cells as (select LineID, len(tokens) as length, paras, unnest(range(len(tokens))) as col, unnest(tokens) as token
      from lines),
    cols as (select length, paras, col, count(distinct token) as words from cells group by all),
    shown as (select LineID, string_agg(case when words > 1 and contents > {cluster_thr} then '<#*#>' else token end,
        ' ' order by col) as Template
      from cells join cols using (length, paras, col) join bins using (length, paras) group by LineID)"""


@query("ael", f"with {PREPARED_SQL}" + _ael_sql(2) + " select LineID, Template from shown")
def ael(spark, sf):
    return mined(spark, sf, "AEL").select("LineID", "Template")


@query("ael_conversations", f"with {_CONVERSATIONS_SQL}" + _ael_sql(3) + " select LineID, Template from shown")
def ael_conversations(spark, sf):
    return mine(conversation_lines(spark, sf), "AEL", (), ",.", cluster_thr=3).select("LineID", "Template")


# Miners that look at one line after the other are stated as recursion over the lines of a bin or leaf, the state
# being the list of groups so far.

_PARTIAL_MERGE_SQL = f"""with recursive {PREPARED_SQL},
    lines as (select LineID, PaddedContent, str_split(PaddedContent, ' ') as tokens, len(regexp_extract_all(MaskedContent, '<#.*#>')) as paras from p),
    distinct_ as (select len(tokens) as length, paras, PaddedContent, any_value(tokens) as tokens, min(LineID) as first from lines group by all),
    placed as (select *, row_number() over (partition by length, paras order by first) as nth, count(*) over (partition by length, paras) as contents
      from distinct_),
    led(length, paras, nth, leaders, leader) as (
      select length, paras, 1::bigint, [tokens], 1::bigint from placed where nth = 1
      union all
      select length, paras, nth, case when met is null then list_append(leaders, tokens) else leaders end, coalesce(met, len(leaders) + 1) from (
        select p.length, p.paras, p.nth, p.tokens, l.leaders, list_filter(range(1, len(l.leaders) + 1), lambda k:
          cast(len(list_filter(range(1, p.length + 1), lambda i: l.leaders[k][i] <> p.tokens[i])) as float) / cast(p.length as float)
          <= cast(0.4 as float))[1] as met
        from led l join placed p on p.length = l.length and p.paras = l.paras and p.nth = l.nth + 1)),
    grouped as (select p.*, case when contents > 2 then leader else -nth end as own from placed p join led using (length, paras, nth)),
    cells as (select length, paras, own, unnest(range(length)) as col, unnest(tokens) as token from grouped),
    cols as (select length, paras, own, col, count(distinct token) as words, min(token) as token from cells group by all),
    texts as (select length, paras, own, string_agg(case when words > 1 then '<#*#>' else token end, ' ' order by col) as Template
      from cols group by all)
    select LineID, Template from lines join grouped g using (PaddedContent)
      join texts t on t.length = g.length and t.paras = g.paras and t.own = g.own"""


@query("ael_partial_merge", _PARTIAL_MERGE_SQL)
def ael_partial_merge(spark, sf):
    return mined(spark, sf, "AEL", merge_thr=0.4).select("LineID", "Template")


def _tree_sql(sources: str, keys: list[str], least: int, fit: str, merge: str) -> str:
    """Leaves by the first keys of a line, 99 of a node having a child of their own; then the lines of a leaf in order.

    ``fit`` scores the groups ``m.groups`` of a leaf for the line ``p.tokens`` as structs (s, w, -k), ``merge`` is the template of
    group ``met`` with the line, ``least`` the tokens a line needs to be found by later ones.
    """
    sql = f"with recursive {sources}, lines as (select LineID, PaddedContent, str_split(PaddedContent, ' ') as tokens from p), n0 as (select *, '' as node from lines)"
    for k, key in enumerate(keys):
        sql += f""",
    k{k} as (select node, key, row_number() over (partition by node order by first) as place
      from (select node, {key} as key, min(LineID) as first from n{k} group by 1, 2) where key is not null),
    n{k + 1} as (select n.LineID, n.PaddedContent, n.tokens, concat(n.node, case when place <= 99 then ' =' || key else ' *' end) as node
      from (select *, {key} as own from n{k}) n join k{k} k on k.node = n.node and k.key = n.own)"""
    return sql + f""",
    placed as (select *, len(tokens) >= {least} as stored, row_number() over (partition by node order by LineID) as nth from n{len(keys)}),
    mined(node, nth, groups, own) as (
      select node, 1::bigint, case when stored then [tokens] else [] end, case when stored then 1::bigint end from placed where nth = 1
      union all
      select node, nth, case when met is not null then list_concat(list_concat(groups[1:met - 1], [{merge}]), groups[met + 1:])
          when stored then list_append(groups, tokens) else groups end, coalesce(met, case when stored then len(groups) + 1 end)
      from (select *, case when best.s > cast(0.4 as float) then -best.k end as met from (
        select p.node, p.nth, p.tokens, p.stored, m.groups, list_max({fit}) as best
        from mined m join placed p on p.node = m.node and p.nth = m.nth + 1))),
    last as (select node, arg_max(groups, nth) as groups from mined group by node)
    select l.LineID, coalesce(array_to_string(t.groups[m.own], ' '), l.PaddedContent) as Template from lines l
      left join placed p on p.LineID = l.LineID left join mined m on m.node = p.node and m.nth = p.nth left join last t on t.node = p.node"""


_SAME_PLACES_SQL = """list_transform(range(1, len(tokens) + 1), lambda i:
    case when i > len(groups[met]) or tokens[i] = groups[met][i] then tokens[i] else '<#*#>' end)"""
_EQUAL_PLACES_SQL = """list_transform(range(1, len(m.groups) + 1), lambda k: {'s': cast(len(list_filter(range(1, least(len(p.tokens), len(m.groups[k])) + 1),
    lambda i: p.tokens[i] = m.groups[k][i] and m.groups[k][i] <> '<#*#>')) as float) / cast(len(p.tokens) as float),
    'w': len(list_filter(m.groups[k][1:len(p.tokens)], lambda x: x = '<#*#>')), 'k': -k})"""
_SHARED_WORDS_SQL = """list_transform(range(1, len(m.groups) + 1), lambda k: {'s': least(cast(1 as float), cast(1.3 as float) * (
    cast(len(list_intersect(list_distinct(p.tokens), list_filter(m.groups[k], lambda x: x <> '<#*#>'))) as float)
    / cast(len(list_distinct(list_concat(p.tokens, list_filter(m.groups[k], lambda x: x <> '<#*#>')))) as float))),
    'w': len(list_filter(m.groups[k], lambda x: x = '<#*#>')), 'k': -k})"""
_WORD_MERGE_SQL = f"""case when len(tokens) = len(groups[met]) then {_SAME_PLACES_SQL}
    when len(tokens) > len(groups[met]) then list_transform(tokens, lambda x: case when list_contains(groups[met], x) then x else '<#*#>' end)
    else list_transform(groups[met], lambda x: case when list_contains(tokens, x) then x else '<#*#>' end) end"""


def _drain_sql(sources: str) -> str:
    return _tree_sql(sources, ["cast(len(tokens) as varchar)", "tokens[1]", "tokens[2]"], 3, _EQUAL_PLACES_SQL, _SAME_PLACES_SQL)


def _leaf_merge_sql(leaf: str, sources: str) -> str:
    """With a low threshold every leaf is one group: its template keeps what all its lines share."""
    return sources + f""", leaves as (select LineID, tokens, {leaf} as leaf from routed),
    cells as (select LineID, leaf, unnest(range(len(tokens))) as col, unnest(tokens) as token from leaves),
    cols as (select leaf, col, count(distinct token) as words from cells group by all),
    shown as (select LineID, string_agg(case when words > 1 then '<#*#>' else token end, ' ' order by col) as Template
      from cells join cols using (leaf, col) group by LineID)
    select LineID, Template from shown"""


_ROUTED_SQL = f"""with {PREPARED_SQL}, lines as (select LineID, str_split(PaddedContent, ' ') as tokens from p),
    firsts as (select tokens[2] as key, row_number() over (order by min(LineID)) as place from lines group by 1),
    routed as (select LineID, tokens, case when place <= 99 then tokens[2] else '*' end as own
      from lines join firsts on tokens[2] = key)"""


@query(
    "drain_low_threshold",
    _leaf_merge_sql("concat_ws(' ', len(tokens), tokens[1], own)", _ROUTED_SQL),
)
def drain_low_threshold(spark, sf):
    return mined(spark, sf, "Drain", sim_thr=0.2).select("LineID", "Template")


_FILES_SQL = f"""with {PREPARED_SQL}, lines as (select LineID, LineID % 3 as file, str_split(PaddedContent, ' ') as tokens from p),
    firsts as (select file, tokens[2] as key, row_number() over (partition by file order by min(LineID)) as place
      from lines group by 1, 2),
    routed as (select LineID, tokens, concat_ws(' ', lines.file, case when place <= 99 then tokens[2] else '*' end) as own
      from lines join firsts on tokens[2] = key and lines.file = firsts.file)"""


@query(
    "extract_several_files",
    "select LineID - 1 as event, Template from (" + _leaf_merge_sql("concat_ws(' ', len(tokens), tokens[1], own)", _FILES_SQL) + ")",
)
def extract_several_files(spark, sf):
    """Three text files, each a log of its own, through the whole extraction."""
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    for k in range(3):
        lines = raw_lines(spark, sf).where(F.col("LineID") % 3 == k)
        lines.coalesce(1).sortWithinPartitions("LineID").select("raw").write.text(f"{folder}/{k}")
    config = FormatConfig("Raw", _RAW_FORMAT, ["Date", "Time"], "%Y-%m-%d %H:%M:%S,%g", delimiters=DELIMITERS)
    found = extract_files(spark, [f"{folder}/{k}" for k in range(3)], config, miner="Drain", sim_thr=0.2)
    return found.structured.select(F.col("EventId").cast("long").alias("event"), "Template")


@query(
    "jaccard_drain_low_threshold",
    _leaf_merge_sql("concat_ws(' ', tokens[1], own, tokens[3])", _ROUTED_SQL),
)
def jaccard_drain_low_threshold(spark, sf):
    return mined(spark, sf, "JaccardDrain", sim_thr=0.2).select("LineID", "Template")


@query("drain_short_lines", f"with {PREPARED_SQL} select LineID, PaddedContent as Template from p")
def drain_short_lines(spark, sf):
    return mined(spark, sf, "Drain", depth=20).select("LineID", "Template")


@query("drain", _drain_sql(PREPARED_SQL))
def drain(spark, sf):
    return mined(spark, sf, "Drain").select("LineID", "Template")


@query("drain_conversations", _drain_sql(_CONVERSATIONS_SQL))
def drain_conversations(spark, sf):
    return mine(conversation_lines(spark, sf), "Drain", (), ",.").select("LineID", "Template")


@query("jaccard_drain", _tree_sql(PREPARED_SQL, ["tokens[1]", "tokens[2]", "tokens[3]"], 4, _SHARED_WORDS_SQL, _WORD_MERGE_SQL))
def jaccard_drain(spark, sf):
    return mined(spark, sf, "JaccardDrain").select("LineID", "Template")


# one longest common subsequence of two token lists, row after row; of several, that over the shorter prefix of the first list
_COMMON_SQL = """list_reduce(list_prepend(list_transform(range(0, len({c}) + 1), lambda j: cast([] as varchar[])), list_transform({t}, lambda x: [[x]])), lambda row, a:
      list_reduce(list_prepend([cast([] as varchar[])], list_transform(range(1, len({c}) + 1), lambda j: [[cast(j as varchar)]])), lambda done, b:
        list_append(done, case
          when {c}[cast(b[1][1] as bigint)] = a[1][1]
            and len(row[cast(b[1][1] as bigint)]) + 1 > greatest(len(row[cast(b[1][1] as bigint) + 1]), len(done[cast(b[1][1] as bigint)]))
            then list_append(row[cast(b[1][1] as bigint)], a[1][1])
          when len(done[cast(b[1][1] as bigint)]) > len(row[cast(b[1][1] as bigint) + 1]) then done[cast(b[1][1] as bigint)]
          else row[cast(b[1][1] as bigint) + 1] end)))[-1]"""


def _prefixes_sql(tokens: str) -> str:
    return f"list_transform(range(1, len({tokens}) + 1), lambda k: {tokens}[1:k])"


def _spell_sql(sources: str) -> str:
    """The state is all templates, how many begin with each run of constants, and which ended at a run last."""
    return f"""with recursive {sources}, lines as (select LineID, str_split(PaddedContent, ' ') as tokens, row_number() over (order by LineID) as nth from p),
    mined(nth, pool, shared, ends, own) as (
      select nth, [tokens], list_transform({_prefixes_sql('tokens')}, lambda x: {{'p': x, 'n': 1::bigint}}), [{{'p': tokens, 'g': 1::bigint}}], 1::bigint from lines where nth = 1
      union all
      select nth, pool,
        list_concat(list_transform(shared, lambda s: {{'p': s.p, 'n': s.n + case when list_contains(entering, s.p) then 1 else 0 end}}),
          list_transform(list_filter(entering, lambda x: not list_contains(list_transform(shared, lambda s: s.p), x)), lambda x: {{'p': x, 'n': 1::bigint}})),
        case when entered is null then ends else list_append(list_filter(ends, lambda x: x.p <> entered), {{'p': entered, 'g': own}}) end, own
      from (select nth, own, entered, coalesce({_prefixes_sql('entered')}, []) as entering,
          case when met is null then list_append(pool, tokens) when same then pool else list_concat(list_concat(pool[1:met - 1], [changed]), pool[met + 1:]) end as pool,
          list_filter(list_transform(shared, lambda s: {{'p': s.p, 'n': s.n - case when list_contains(leaving[1:gone - 1], s.p) then 1 else 0 end}}),
            lambda s: not list_contains(leaving[gone:], s.p)) as shared,
          list_filter(ends, lambda x: not list_contains(leaving[gone:], x.p)) as ends
        from (select *, coalesce(list_filter(range(1, len(leaving) + 1), lambda k:
              coalesce(list_filter(shared, lambda s: s.p = leaving[k])[1].n, 0) <= 1)[1], len(leaving) + 1) as gone
          from (select *, coalesce(met, len(pool) + 1) as own,
              case when met is null then tokens when not same then list_filter(changed, lambda x: x <> '<#*#>') end as entered,
              case when same or met is null then cast([] as varchar[][]) else {_prefixes_sql('old')} end as leaving
            from (select *, changed = pool[met] as same, list_filter(pool[met], lambda x: x <> '<#*#>') as old
              from (select *, case when len(commons[met]) = 0 then [] else list_reduce(list_prepend({{'left': commons[met], 'made': cast([] as varchar[])}},
                    list_transform(pool[met], lambda x: {{'left': [x], 'made': cast([] as varchar[])}})), lambda s, x: case
                      when len(s.left) > 0 and s.left[1] = x.left[1] then {{'left': s.left[2:], 'made': list_append(s.made, x.left[1])}}
                      when s.made[-1] = '<#*#>' then s else {{'left': s.left, 'made': list_append(s.made, '<#*#>')}} end).made end as changed
                from (select *, coalesce(by_prefix, list_filter(range(1, len(pool) + 1), lambda k: len(pool[k]) >= need and len(commons[k]) = len(pool[k]))[1],
                    -list_max(list_transform(list_filter(range(1, len(pool) + 1), lambda k: len(commons[k]) >= greatest(1, ceil(need), ceil(cast(0.5 as float) * len(pool[k])))),
                      lambda k: {{'l': len(commons[k]), 's': -len(pool[k]), 'k': -k}})).k) as met
                  from (select l.nth, l.tokens, pool, shared, ends, cast(0.5 as float) * len(l.tokens) as need,
                      list_transform(pool, lambda o: {_COMMON_SQL.format(c='o', t='l.tokens')}) as commons,
                      list_reduce(list_prepend({{'seen': cast([] as varchar[]), 'hit': null::bigint}}, list_transform(l.tokens, lambda x: {{'seen': [x], 'hit': null::bigint}})),
                        lambda s, x: case when s.hit is not null then s
                          when len(s.seen) >= cast(0.5 as float) * len(l.tokens) and len(list_filter(ends, lambda y: y.p = s.seen)) > 0
                            then {{'seen': s.seen, 'hit': list_filter(ends, lambda y: y.p = s.seen)[1].g}}
                          when len(list_filter(shared, lambda y: y.p = list_append(s.seen, x.seen[1]) and y.n > 0)) > 0
                            then {{'seen': list_append(s.seen, x.seen[1]), 'hit': null::bigint}} else s end).hit as by_prefix
                    from mined m join lines l on l.nth = m.nth + 1)))))))),
    last as (select arg_max(pool, nth) as pool from mined)
    select l.LineID, array_to_string(last.pool[m.own], ' ') as Template from lines l join mined m using (nth), last"""


@query("spell_conversations")
def spell_conversations(spark, sf):
    """Free text: nearly every line opens a group."""
    return mine(conversation_lines(spark, sf), "Spell", (), ",.").select("LineID", "Template")


@query("spell", _spell_sql(PREPARED_SQL))
def spell(spark, sf):
    return mined(spark, sf, "Spell").select("LineID", "Template")


# --- browsing ------------------------------------------------------------------------------------


@query(
    "filtered_rows",
    f"""with {LOG_SQL} select LineID, Level, Component, Content from log
    where Level in ('ERROR', 'CLICK') and Component in ('svc1', 'svc4')""",
)
def filtered_rows(spark, sf):
    rows = browse.filtered(log(spark, sf), {"Level": ["ERROR", "CLICK"], "Component": ["svc1", "svc4"]})
    return rows.select("LineID", "Level", "Component", "Content")


@query(
    "filtered_lines_by_number",
    f"with {LOG_SQL} select LineID, Level from log where cast(LineID as varchar) in ('7', '70', '700')",
)
def filtered_lines_by_number(spark, sf):
    return browse.filtered(log(spark, sf), {"LineID": ["7", "70", "700"]}).select("LineID", "Level")


@query(
    "keyword_rows",
    f"with {LOG_SQL} select LineID, Content from log where contains(Content, 'click via')",
)
def keyword_rows(spark, sf):
    rows = log(spark, sf).where(text.contains_keyword(F.col("Content"), "click via"))
    return rows.select("LineID", "Content")


@query(
    "value_histogram",
    f"""with {LOG_SQL} select Component, count(*) as Count from log
    where Level in ('ERROR', 'VIEW') and contains(lower(Component), 'svc') group by Component""",
)
def value_histogram(spark, sf):
    filters = {"Level": ["ERROR", "VIEW"], "Component": ["svc1"]}
    return browse.value_histogram(log(spark, sf), "Component", "SVC", filters)


@query(
    "value_histogram_case_sensitive",
    f"with {LOG_SQL} select Component, count(*) as Count from log where contains(Component, 'svc1') group by Component",
)
def value_histogram_case_sensitive(spark, sf):
    return browse.value_histogram(log(spark, sf), "Component", "SVC1", ignore_case=False)


@query(
    "page",
    f"""with {LOG_SQL} select LineID, Level, Content from log where Level in ('ERROR') order by LineID
    limit 1000 offset 200""",
)
def page(spark, sf):
    return browse.page(log(spark, sf), 200, 1000, {"Level": ["ERROR"]}).select("LineID", "Level", "Content")


@query(
    "page_to_the_end",
    f"with {LOG_SQL} select LineID, Level from log where Level in ('ERROR') order by LineID offset 100",
)
def page_to_the_end(spark, sf):
    return browse.page(log(spark, sf), 100, -1, {"Level": ["ERROR"]}).select("LineID", "Level")


@query(
    "next_page",
    f"with {LOG_SQL} select LineID, Level, Content from log where LineID > 400 order by LineID limit 200",
)
def next_page(spark, sf):
    return browse.next_page(log(spark, sf), 400, 200).select("LineID", "Level", "Content")


# --- registry ------------------------------------------------------------------------------------
# customers stand for registered logs, orders for paths to add

_REGISTRY_SQL = """r as (select c_custkey as id, c_mktsegment as format_type,
  concat('/logs/', c_name, case when c_custkey % 2 = 0 then '.LOG' else '.txt' end) as log_path,
  c_acctbal > 0 as is_extracted,
  case when c_acctbal > 0 then 'Drain' else '' end as extract_method,
  cast(c_nationkey as bigint) as line_count from customer)"""


def registry(spark, sf):
    extension = F.when(F.col("c_custkey") % 2 == 0, ".LOG").otherwise(".txt")
    extracted = F.col("c_acctbal") > 0
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("format_type"),
        F.concat(F.lit("/logs/"), "c_name", extension).alias("log_path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("create_time"),
        extracted.alias("is_extracted"),
        F.when(extracted, "Drain").otherwise("").alias("extract_method"),
        F.col("c_nationkey").cast("long").alias("line_count"),
        F.lit(False).alias("deleted"),
    )


@query(
    "registry_extracted",
    f"""with {_REGISTRY_SQL} select id, log_path, concat('s_', id) as structured_table_name,
      concat('t_', id) as templates_table_name from r where is_extracted""",
)
def registry_extracted(spark, sf):
    return reg.extracted_logs(registry(spark, sf))


_NEW_SQL = """n as (select o_orderkey as position,
  concat('/logs/', case when o_custkey % 3 = 0 then c_name else concat('order', o_custkey) end,
    case when o_custkey % 2 = 0 then '.LOG' else '.txt' end) as log_path
  from orders join customer on o_custkey = c_custkey),
  o as (select position, log_path, case when log_path in (select log_path from r)
    or position > min(position) over (partition by log_path) then -1 else 0 end as code from n)"""


def new_paths(spark, sf):
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    name = F.when(F.col("o_custkey") % 3 == 0, F.col("c_name")).otherwise(
        F.concat(F.lit("order"), F.col("o_custkey").cast("string"))
    )
    extension = F.when(F.col("o_custkey") % 2 == 0, ".LOG").otherwise(".txt")
    return joined.select(
        F.col("o_orderkey").alias("position"), F.concat(F.lit("/logs/"), name, extension).alias("log_path")
    )


@query("registry_insert_codes", f"with {_REGISTRY_SQL}, {_NEW_SQL} select position, log_path, code from o")
def registry_insert_codes(spark, sf):
    return reg.insert_outcome(registry(spark, sf), new_paths(spark, sf))


@query(
    "registry_insert",
    f"""with {_REGISTRY_SQL}, {_NEW_SQL}
    select id, log_path, is_extracted, line_count from r union all
    select (select max(id) from r) + row_number() over (order by position), log_path, false, 0 from o where code = 0""",
)
def registry_insert(spark, sf):
    grown = reg.insert_logs(registry(spark, sf), new_paths(spark, sf))
    return grown.select("id", "log_path", "is_extracted", "line_count")


@query(
    "registry_update_delete",
    f"""with {_REGISTRY_SQL} select id, case when id = 5 then 'Linux' else format_type end as format_type,
      case when id = 6 then true else is_extracted end as is_extracted,
      case when id = 6 then 4242 else line_count end as line_count,
      case when id = 6 then 'Spell' else extract_method end as extract_method from r where id <> 9""",
)
def registry_update_delete(spark, sf):
    r = reg.update_log(registry(spark, sf), 5, "format_type", "Linux")
    r = reg.update_log(r, 6, "is_extracted", True)
    r = reg.update_log(r, 6, "line_count", 4242)
    r = reg.update_log(r, 6, "extract_method", "Spell")
    r = reg.delete_log(r, 9)
    return reg.logs(r).select("id", "format_type", "is_extracted", "line_count", "extract_method")


@query(
    "registry_search",
    f"""with {_REGISTRY_SQL} select id, str_split(log_path, '/')[-1] as name,
      case when is_extracted then 'EXTRACTED' else 'NOT_EXTRACTED' end as status
    from r where contains(lower(str_split(log_path, '/')[-1]), '8.log')""",
)
def registry_search(spark, sf):
    found = reg.search_logs(reg.with_status(reg.logs(registry(spark, sf))), " 8.LOG ")
    return reg.sort_logs(found, "status", descending=True).select(
        "id", text.basename(F.col("log_path")).alias("name"), "status"
    )


@query(
    "registry_sorted",
    f"""with {_REGISTRY_SQL}, x as (select id, nullif(extract_method, '') as extract_method from r)
    select id, extract_method, row_number() over (order by extract_method desc nulls first, id) as place from x""",
)
def registry_sorted(spark, sf):
    shown = reg.logs(registry(spark, sf)).withColumn("extract_method", F.nullif("extract_method", F.lit("")))
    order = reg.sort_order("extract_method", descending=True)
    return with_rank(shown, order, "place").select("id", "extract_method", (F.col("place") + 1).alias("place"))


# --- vectors -------------------------------------------------------------------------------------


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )


_NEAR_SQL = """e as (select vec_id as id, embedding::double[] as v from embeddings),
  near as (select a.id as id, b.id as other from e a, e b
    where list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) <= 1.2 * 1.2),
  deg as (select id, count(*) as neighbours from near group by id)"""


@query("vector_neighbours", f"with {_NEAR_SQL} select id, neighbours from deg")
def vector_neighbours(spark, sf):
    return neighbour_counts(vectors(spark, sf), 1.2)


@query(
    "vector_clusters",
    f"""with recursive {_NEAR_SQL}, core as (select id from deg where neighbours >= 8),
    links as (select id, other from near where id in (from core) and other in (from core)),
    reach(id, other) as (select id, other from links union
      select reach.id, links.other from reach join links on reach.other = links.id),
    comp as (select id, min(other) as name from reach group by id),
    names as (select name, row_number() over (order by name) - 1 as cluster from (select distinct name from comp)),
    border as (select near.id, min(name) as name from near join comp on other = comp.id
      where near.id not in (from core) group by near.id)
    select e.id, coalesce(cluster, -1)::integer as cluster
    from e left join (from comp union all from border) using (id) left join names using (name)""",
)
def vector_clusters(spark, sf):
    return density_clusters(vectors(spark, sf), 1.2, 8)


@query("vector_plane")
def vector_plane(spark, sf):
    return embedding.cluster_vectors(vectors(spark, sf), 0.7, 5)


@query("template_clusters")
def template_clusters(spark, sf):
    return embedding.cluster_templates(template_table(structured(spark, sf)), 0.6, 5)


# --- training-data operators: only where their folder and file are there -------------------------


def _optional(module: str):
    """The module, or ``None`` where it is not part of this copy; any other failed import is an error."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as missing:
        if missing.name not in {"logweave.llm", module}:
            raise
        return None


for _module in map(_optional, ("logweave.llm.queries", "corpus_pipeline")):
    if _module is not None:
        _QUERIES.update(_module.QUERIES)
        _SQL.update(_module.SQL)


# --- driver contract -----------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Mine templates from the log and count which follows which."""
    ship(spark)
    return brain_transition(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    def shipped(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark, sf):
            ship(spark)
            return fn(spark, sf)

        return run

    return {name: shipped(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
