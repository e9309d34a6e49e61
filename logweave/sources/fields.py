"""From raw lines to named fields and a timestamp, by a declared line format."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import timing

_FIELD = re.compile(r"\{([A-Za-z_][\w-]*)(?::([<>^]))?\}")
_SEPARATOR = "\u0001"
# What an aligned field looks like, the group being the field itself.
_ALIGNED = {None: "(.+?)", "<": "(.+?) *", ">": " *(.+?)", "^": " *(.+?) *"}


@dataclass(frozen=True)
class LineFormat:
    """The anchored expression of a format such as ``{Date} {Level:<} {Content}`` and its field names."""

    regex: str
    fields: tuple[str, ...]

    @classmethod
    def compile(cls, text: str) -> "LineFormat":
        found = list(_FIELD.finditer(text))
        fields = [m.group(1) for m in found]
        pieces = [_literal(text[: found[0].start()] if found else text)]
        for m, following in zip(found, [*found[1:], None]):
            literal = _literal(text[m.end() : following.start() if following else len(text)])
            field = _ALIGNED[m.group(2)] + literal
            # A plain field ends at the first place of its separator: that leaves the most to the field behind,
            # so no later place can fit if this one does not, and going back over it would be exponential.
            pieces.append(f"(?>{field})" if literal and following and not m.group(2) else field)
        if not fields:
            raise ValueError(f"no field in line format {text!r}")
        if len(set(fields)) != len(fields):
            raise ValueError(f"repeated field in line format {text!r}")
        # (?s) lets '.' take a carriage return, \z allows nothing behind the last field
        return cls("(?s)^" + "".join(pieces) + r"\z", tuple(fields))


def _literal(text: str) -> str:
    rest = text.replace("{{", "").replace("}}", "")
    if "{" in rest or "}" in rest:
        raise ValueError(f"unsupported field near {text!r}")
    return re.sub(r"([?\\.\[\](){}*+^$!|])", r"\\\1", text.replace("{{", "{").replace("}}", "}"))


def capture(raw: Column, fmt: LineFormat) -> Column:
    """All fields behind an empty element, in one pass of the expression.

    A line that does not fit comes back whole, as the only element; one with the separator is NULL.
    """
    joined = F.regexp_replace(
        raw, fmt.regex, "".join(f"{_SEPARATOR}${i}" for i in range(1, len(fmt.fields) + 1))
    )
    return F.when(~F.contains(raw, F.lit(_SEPARATOR)), F.split(joined, _SEPARATOR, -1))


def parse_lines(
    lines: DataFrame, log_format: str, timestamp_fields: Sequence[str], timestamp_format: str, default_year: int = 1900
) -> DataFrame:
    """``(LineID, raw)`` to ``(LineID, raw, Timestamp, fields…, reason)``.

    Several time fields are joined by a space; the format ``epoch`` reads the first one only. ``reason``
    is NULL for good lines and for blank ones, which keep NULL in every field. ``default_year`` stands in for
    a year the time format lacks.
    """
    fmt = LineFormat.compile(log_format)
    column = {name: F.get("_parts", F.lit(i + 1)) for i, name in enumerate(fmt.fields)}
    times = [column[n] for n in timestamp_fields]
    if timestamp_format == "epoch":
        time_parts, timestamp = times[0], timing.epoch_timestamp(F.col("_time"))
    else:
        text = times[0] if len(times) == 1 else F.concat_ws(" ", *times)
        time_parts = timing.timestamp_parts(text, timestamp_format)
        timestamp = timing.timestamp_from_parts(F.col("_time"), timestamp_format, default_year)
    kept = [n for n in fmt.fields if n not in timestamp_fields]
    passed = [c for c in lines.columns if c not in ("LineID", "raw")]
    # exploding a one-element array keeps the optimizer from copying the regular expressions into every
    # later use and filter: each is evaluated once per line
    parsed = (
        lines.withColumn("_parts", F.explode(F.array(capture(F.col("raw"), fmt))))
        .withColumn("_time", F.explode(F.array(time_parts)))
        .withColumn("_at", F.explode(F.array(timestamp)))
    )
    reason = (
        F.when(F.col("raw").isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(F.size("_parts"), F.lit(0)) <= 1, F.lit("line format"))
        .when(F.col("_at").isNull(), F.lit("timestamp format"))
    )
    return parsed.select(
        *passed, "LineID", "raw", F.col("_at").alias("Timestamp"), *[column[n].alias(n) for n in kept],
        reason.alias("reason"),
    )


def reject_bad(parsed: DataFrame) -> DataFrame:
    """Parity mode: the first line that does not fit fails the job."""
    checked = F.when(
        F.col("reason").isNotNull(),
        F.raise_error(F.concat(F.lit("line "), F.col("LineID"), F.lit(" does not fit the "), F.col("reason"))),
    )
    return parsed.withColumn("LineID", F.coalesce(checked.cast("long"), F.col("LineID"))).drop("raw", "reason")


def split_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine mode: good rows, and ``(LineID, raw, reason)`` of the others."""
    good = parsed.where(F.col("reason").isNull()).drop("raw", "reason")
    passed = [c for c in parsed.columns if c == "source_path"]
    return good, parsed.where(F.col("reason").isNotNull()).select(*passed, "LineID", "raw", "reason")
