"""Line-format configurations: fields, checks, JSON form and miner parameters."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from logweave.functions.text import Mask
from logweave.sources.fields import LineFormat

# Built-in masks, applied behind the user's own.
BUILTIN_MASKS: tuple[Mask, ...] = ((r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{0,})?", "<#IP#>"),)

# Fixed values: (default, lowest, highest) of every miner parameter.
PARAMETERS = {
    "AEL": {"cluster_thr": (2, 1, 1000), "merge_thr": (1.0, 0.0, 1.0)},
    "Brain": {"var_thr": (2, 1, 100)},
    "Drain": {"depth": (4, 3, 100), "children": (100, 1, 1000), "sim_thr": (0.4, 0.0, 1.0)},
    "JaccardDrain": {"depth": (4, 2, 100), "children": (100, 1, 1000), "sim_thr": (0.4, 0.0, 1.0)},
    "Spell": {"sim_thr": (0.5, 0.0, 1.0)},
}


#: Columns that parsing and mining add; Spark does not tell ``Raw`` from ``raw``.
RESERVED = frozenset(("lineid", "timestamp", "raw", "_raw", "reason", "template", "maskedcontent", "paddedcontent", "source_path"))


def check_parameters(miner: str, params: dict) -> dict:
    """Defaults filled in; unknown names and values out of range are errors."""
    if miner not in PARAMETERS:
        raise ValueError(f"unknown miner {miner!r}, one of {sorted(PARAMETERS)}")
    known = PARAMETERS[miner]
    for name, value in params.items():
        if name not in known:
            raise ValueError(f"{miner} has no parameter {name!r}")
        _, low, high = known[name]
        if not low <= value <= high:
            raise ValueError(f"{miner}.{name} must lie in {low}..{high}, not {value}")
    return {name: params.get(name, spec[0]) for name, spec in known.items()}


@dataclass(frozen=True)
class FormatConfig:
    name: str
    log_format: str
    timestamp_fields: tuple[str, ...]
    timestamp_format: str
    user_masks: tuple[Mask, ...] = ()
    delimiters: str = ""
    use_builtin_masks: bool = True
    ex_args: dict[str, dict[str, int | float]] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        for attribute in ("name", "log_format", "timestamp_format"):
            if not getattr(self, attribute).strip():
                raise ValueError(f"{attribute} must not be empty")
        object.__setattr__(self, "timestamp_fields", tuple(self.timestamp_fields))
        object.__setattr__(self, "user_masks", tuple((m[0], m[1]) for m in _checked_masks(self.user_masks)))
        if not self.timestamp_fields:
            raise ValueError("timestamp_fields must not be empty")
        fields = LineFormat.compile(self.log_format).fields
        for f in self.timestamp_fields:
            if f not in fields:
                raise ValueError(f"timestamp field {f!r} is not in the line format")
        for f in set(fields) - set(self.timestamp_fields):
            if f.lower() in RESERVED:
                raise ValueError(f"{f!r} is a column of the extraction itself, name the field differently")
        if "Content" not in fields:
            raise ValueError("the line format needs a {Content} field")
        if not self.delimiters.isascii():
            raise ValueError("delimiters must be ASCII")

    @property
    def masks(self) -> tuple[Mask, ...]:
        return self.user_masks + BUILTIN_MASKS if self.use_builtin_masks else self.user_masks

    def parameters(self, miner: str, tuned: bool = True, **overrides) -> dict:
        """Parameters of a miner: defaults, then this format's own if ``tuned``, then ``overrides``."""
        own = self.ex_args.get(miner, {}) if tuned else {}
        return check_parameters(miner, {**own, **overrides})

    def to_dict(self) -> dict:
        plain = dataclasses.asdict(self)
        plain["timestamp_fields"] = list(self.timestamp_fields)
        plain["user_masks"] = [list(m) for m in self.user_masks]
        return plain

    @classmethod
    def from_dict(cls, plain: dict) -> "FormatConfig":
        return cls(**plain)


def _checked_masks(masks: Iterable) -> list:
    checked = []
    for m in masks:
        if not isinstance(m, (list, tuple)) or len(m) != 2 or not all(isinstance(t, str) for t in m):
            raise ValueError("masks must be [regex, replacement] pairs")
        if not (m[0].isascii() and m[1].isascii()):
            raise ValueError("masks must be ASCII")
        # named groups are written differently in Java, whose engine runs the masks
        m = [re.sub(r"\(\?P<", "(?<", m[0]), m[1]]
        try:
            re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", m[0]))
        except re.error as e:
            raise ValueError(f"invalid mask {m[0]!r}: {e}") from e
        checked.append(m)
    return checked


def to_json(configs: Iterable[FormatConfig]) -> str:
    return json.dumps([c.to_dict() for c in configs], indent=2)


def from_json(text: str) -> list[FormatConfig]:
    return [FormatConfig.from_dict(d) for d in json.loads(text)]


def as_table(spark: SparkSession, configs: Iterable[FormatConfig]) -> DataFrame:
    schema = (
        "name string, log_format string, timestamp_fields array<string>, timestamp_format string,"
        " user_masks array<array<string>>, delimiters string, use_builtin_masks boolean,"
        " ex_args map<string, map<string, double>>"
    )
    rows = []
    for c in configs:
        plain = c.to_dict()
        plain["ex_args"] = {m: {k: float(v) for k, v in p.items()} for m, p in plain["ex_args"].items()}
        rows.append(tuple(plain.values()))
    return spark.createDataFrame(rows, schema)
