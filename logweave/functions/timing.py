"""Timestamps of log lines and fixed-width time buckets.

Everything works on microseconds since the epoch, so results do not depend on the session time zone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bucket widths offered to the user, as (months, days, microseconds).
WIDTHS = {
    "1 second": (0, 0, 1_000_000),
    "10 seconds": (0, 0, 10_000_000),
    "1 minute": (0, 0, 60_000_000),
    "5 minutes": (0, 0, 300_000_000),
    "10 minutes": (0, 0, 600_000_000),
    "30 minutes": (0, 0, 1_800_000_000),
    "1 hour": (0, 0, 3_600_000_000),
    "6 hours": (0, 0, 21_600_000_000),
    "1 day": (0, 1, 0),
    "1 week": (0, 7, 0),
    "1 month": (1, 0, 0),
}
DEFAULT_WIDTH = "1 minute"

DAY_MICROS = 86_400_000_000
# Bucket origins, Monday 2000-01-03 for exact widths and January 2000 for months.
ORIGIN_MICROS = 946_857_600_000_000
ORIGIN_MONTH = 2000 * 12


@dataclass(frozen=True)
class Width:
    """A bucket width: either whole months, or days plus microseconds."""

    months: int = 0
    days: int = 0
    micros: int = 0

    def __post_init__(self):
        if self.months and (self.days or self.micros):
            raise ValueError("a width is either months or days and microseconds")
        if self.months < 0 or (not self.months and self.days * DAY_MICROS + self.micros <= 0):
            raise ValueError("a width must be positive")

    @classmethod
    def of(cls, width: "Width | str | tuple[int, int, int]") -> "Width":
        if isinstance(width, Width):
            return width
        if isinstance(width, str):
            if width not in WIDTHS:
                raise ValueError(f"unknown width {width!r}, one of {sorted(WIDTHS)}")
            return cls(*WIDTHS[width])
        return cls(*width)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def _floor_div(number: Column, by: int) -> Column:
    """Exact integer floor division."""
    divisor = F.lit(by).cast("long")
    return ((number - F.pmod(number, divisor)) / divisor).cast("long")


def bucket_number(ts: Column, width: "Width | str") -> Column:
    """Which bucket ``ts`` falls into, counted from the origin; NULL stays NULL."""
    w = Width.of(width)
    if w.months:
        day = F.date_add(F.lit("1970-01-01").cast("date"), _floor_div(epoch_micros(ts), DAY_MICROS).cast("int"))
        return _floor_div((F.year(day) * 12 + F.month(day) - 1 - ORIGIN_MONTH).cast("long"), w.months)
    return _floor_div(epoch_micros(ts) - ORIGIN_MICROS, w.days * DAY_MICROS + w.micros)


def bucket_seconds(ts: Column, width: "Width | str") -> Column:
    """Start of the bucket of ``ts`` in epoch seconds; NULL stays NULL and forms its own group."""
    w = Width.of(width)
    number = bucket_number(ts, w)
    if w.months:
        month = number * w.months + ORIGIN_MONTH
        year = _floor_div(month, 12)
        first = F.make_date(year.cast("int"), (month - year * 12 + 1).cast("int"), F.lit(1))
        return F.unix_date(first).cast("long") * 86_400
    return _floor_div(number * (w.days * DAY_MICROS + w.micros) + ORIGIN_MICROS, 1_000_000)


def time_bucket(ts: Column, width: "Width | str") -> Column:
    return F.timestamp_seconds(bucket_seconds(ts, width))


def round_to_second(micros: Column) -> Column:
    """Whole seconds as a timestamp, a half rounded away from the epoch."""
    away = F.when(micros < 0, -_floor_div(500_000 - micros, 1_000_000)).otherwise(
        _floor_div(micros + 500_000, 1_000_000)
    )
    return F.timestamp_seconds(away)


def epoch_timestamp(field: Column) -> Column:
    """A field that holds Unix seconds."""
    return F.timestamp_seconds(F.round(F.trim(field).try_cast("decimal(20,3)"), 0).cast("long"))


# Month and weekday names of the C locale.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")

# strptime specifier -> (part name, regular expression); a '-' flag is accepted and means the same here
_PARTS = {
    "Y": ("year", r"\d{1,4}"),
    "y": ("short_year", r"\d{1,2}"),
    "m": ("month", r"\d{1,2}"),
    "b": ("month_name", "(?i:" + "|".join(MONTHS) + ")"),
    "d": ("day", r"\d{1,2}"),
    "H": ("hour", r"\d{1,2}"),
    "M": ("minute", r"\d{1,2}"),
    "S": ("second", r"\d{1,2}"),
    "g": ("millis", r"\d{1,3}"),
}
_COMPOSITE = {"c": "%Y-%m-%d %H:%M:%S"}


def _strptime_regex(fmt: str) -> tuple[str, list[str]]:
    """One anchored regular expression for a strptime format, and the part each group holds."""
    fmt = re.sub(r"%([c])", lambda m: _COMPOSITE[m.group(1)], fmt)
    regex, parts = [], []
    for spec, space, literal in re.findall(r"%-?([A-Za-z])|(\s+)|([^%\s])", fmt):
        if space:
            regex.append(r"\s+")
        elif literal:
            regex.append(re.escape(literal))
        elif spec == "a":
            regex.append("(?i:" + "|".join(WEEKDAYS) + ")")
        elif spec in _PARTS:
            name, pattern = _PARTS[spec]
            parts.append(name)
            regex.append(f"({pattern})")
        else:
            raise ValueError(f"unsupported time specifier %{spec}")
    return r"^\s*" + "".join(regex) + r"\s*\z", parts


def timestamp_parts(text: Column, fmt: str) -> Column:
    """The pieces of a time text by a strptime format, behind an empty one, in one pass.

    A text that does not fit comes back whole, as the only element.
    """
    regex, parts = _strptime_regex(fmt)
    joined = F.regexp_replace(text, regex, "".join(f"\u0001${i}" for i in range(1, len(parts) + 1)))
    return F.split(joined, "\u0001", -1)


def timestamp_from_parts(pieces: Column, fmt: str, default_year: int = 1900) -> Column:
    """The pieces as whole seconds, rounded; NULL for a date or time that does not exist.

    Integer arithmetic covers what Spark's datetime patterns do not: weekday names, a missing year and
    fields without leading zeros. ``pieces`` is used once per part, so it should be a stored column.
    """
    _, parts = _strptime_regex(fmt)
    at = {name: F.get(pieces, F.lit(i + 1)) for i, name in enumerate(parts)}
    number = {name: c.cast("int") for name, c in at.items() if name != "month_name"}
    if "year" in at:
        year = number["year"]
    elif "short_year" in at:
        year = number["short_year"] + F.when(number["short_year"] < 69, 2000).otherwise(1900)
    else:
        year = F.when(F.size(pieces) > 1, default_year)
    if "month_name" in at:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(at["month_name"])).cast("int")
    else:
        month = number.get("month", F.lit(1))
    second = number.get("second", F.lit(0))
    whole = F.try_make_timestamp(
        year,
        month,
        number.get("day", F.lit(1)),
        number.get("hour", F.lit(0)),
        number.get("minute", F.lit(0)),
        F.when(second < 60, second).cast("decimal(16,6)"),  # Spark would carry 60 into the next minute
        F.lit("UTC"),
    )
    if "millis" not in at:
        return whole
    # digits are a decimal fraction: '6' is 600 ms
    return round_to_second(F.unix_micros(whole) + F.rpad(at["millis"], 3, "0").cast("int") * 1000)


def parse_timestamp(text: Column, fmt: str, default_year: int = 1900) -> Column:
    return timestamp_from_parts(timestamp_parts(text, fmt), fmt, default_year)
