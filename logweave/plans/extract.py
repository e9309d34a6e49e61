"""Template extraction: parsed lines in, structured and template tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import Mask, mask, pad_delimiters
from logweave.operators.ael import mine_ael
from logweave.operators.brain import mine_brain
from logweave.operators.joins import lookup_join
from logweave.operators.prefix_tree import mine_drain, mine_jaccard_drain
from logweave.operators.sequence import with_rank
from logweave.operators.spell import mine_spell
from logweave.plans.config import PARAMETERS, FormatConfig, check_parameters
from logweave.session import materialize
from logweave.sources.fields import parse_lines, reject_bad, split_bad
from logweave.sources.lines import read_log_lines

Miner = Callable[..., DataFrame]
MINERS: dict[str, Miner] = {
    "AEL": mine_ael,
    "Brain": mine_brain,
    "Drain": mine_drain,
    "JaccardDrain": mine_jaccard_drain,
    "Spell": mine_spell,
}


_IN_BLOCKS = frozenset(("AEL", "Drain", "JaccardDrain", "Spell"))  # miners that replay lines in blocks


def register_miner(name: str, miner: Miner, parameters: Mapping[str, tuple[float, float, float]]) -> None:
    """Make a miner of your own known under ``name``, for ``mine``, ``extract`` and the store.

    It is called with a frame that has ``LineID``, ``content`` (masked, delimiters padded) and ``MaskedContent`` beside other
    columns, and with ``parameters``, given as (default, lowest, highest); with several logs also with ``log``, the column that
    tells them apart. It returns the frame with ``Template``.
    """
    if name in MINERS:
        raise ValueError(f"there is a miner {name!r} already")
    for parameter, (default, low, high) in parameters.items():
        if not low <= default <= high:
            raise ValueError(f"the default of {parameter!r} must lie in {low}..{high}")
    MINERS[name] = miner
    PARAMETERS[name] = dict(parameters)


@dataclass(frozen=True)
class Extraction:
    structured: DataFrame
    templates: DataFrame
    bad_lines: DataFrame | None = None


def prepare(parsed: DataFrame, masks: Sequence[Mask] = (), delimiters: str = "") -> DataFrame:
    """Add ``MaskedContent`` and ``PaddedContent``, the masked text with padded delimiters.

    Tokens are the padded text split on single spaces. The text stands for them as a key, since joining
    the tokens gives it back.
    """
    masked = parsed.withColumn("MaskedContent", mask(F.col("Content"), masks))
    return masked.withColumn("PaddedContent", pad_delimiters(F.col("MaskedContent"), delimiters))


def mine(
    parsed: DataFrame, miner: str, masks: Sequence[Mask] = (), delimiters: str = "", block_lines=None, log: str | None = None, **params
) -> DataFrame:
    """Give every row of ``parsed`` (``LineID``, ``Content``, …) its ``Template``; NULL content gets NULL.

    ``log`` names a column that tells several logs apart; each is mined as if it were alone, all in the same jobs.
    """
    arguments = check_parameters(miner, params)
    if block_lines and miner in _IN_BLOCKS:
        arguments["block_lines"] = block_lines
    if log:
        arguments["log"] = log
    # every miner reads its input more than once, so parsing and masking are done and written once;
    # Spark does not tell `content` from `Content`, so the original steps aside meanwhile
    work = prepare(parsed, masks, delimiters).withColumnsRenamed({"Content": "_raw", "PaddedContent": "content"})
    mined = MINERS[miner](materialize(work), **arguments).drop("content").withColumnRenamed("_raw", "Content")
    return mined.select(*parsed.columns, "Template")


def template_table(structured: DataFrame, log: str | None = None) -> DataFrame:
    """``(template_id, Template, Count)``; ids are ranks by Count, ties by text, from 0 in each log."""
    own = [log] if log else []
    counts = structured.where(F.col("Template").isNotNull()).groupBy(*own, "Template").agg(F.count("*").alias("Count"))
    ranked = with_rank(counts, [*map(F.asc, own), F.desc("Count"), F.asc("Template")], "template_id")
    if log:
        ranked = materialize(ranked)
        firsts = ranked.groupBy(log).agg(F.min("template_id").alias("_first"), F.count("*").alias("_n"))
        ranked = lookup_join(ranked, firsts, log, weight="_n").withColumn("template_id", F.col("template_id") - F.col("_first"))
    return materialize(ranked.select(*own, "template_id", "Template", "Count"))


def extract(
    lines: DataFrame,
    config: FormatConfig,
    miner: str = "Drain",
    masks: str = "config",
    tuned: bool = True,
    on_bad: str = "fail",
    block_lines: int | None = None,
    default_year: int = 1900,
    log: str | None = None,
    **params,
) -> Extraction:
    """Parse, mask and mine numbered lines ``(LineID, raw)``, of several logs if ``log`` names a column that tells them apart.

    ``masks="user"`` leaves the built-in masks out, ``tuned=False`` ignores the parameters stored in the
    format. ``on_bad="fail"`` stops at the first line that does not fit, ``"quarantine"`` sets it aside.
    """
    if masks not in ("config", "user") or on_bad not in ("fail", "quarantine"):
        raise ValueError("masks is 'config' or 'user', on_bad is 'fail' or 'quarantine'")
    parsed = parse_lines(lines, config.log_format, config.timestamp_fields, config.timestamp_format, default_year)
    bad = None
    if on_bad == "fail":
        good = reject_bad(parsed)
    else:
        good, bad = split_bad(parsed)
    structured = materialize(
        mine(
            good,
            miner,
            config.masks if masks == "config" else config.user_masks,
            config.delimiters,
            block_lines,
            log,
            **config.parameters(miner, tuned, **params),
        )
    )
    return Extraction(structured, template_table(structured, log), bad)


def _files(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    return sorted(spark.read.text(paths if isinstance(paths, str) else list(paths)).inputFiles())


def extract_file(spark: SparkSession, path: str, config: FormatConfig, **options) -> Extraction:
    """``extract`` over one text file; several files are several logs, see ``extract_files``."""
    if len(_files(spark, path)) > 1:
        raise ValueError(f"{path} holds several files; extract_files takes each as a log of its own")
    return extract(read_log_lines(spark, path).drop("source_path"), config, **options)


def extract_files(spark: SparkSession, paths: str | Sequence[str], config: FormatConfig, **options) -> Extraction:
    """Every text file under ``paths`` as a log of its own, all of them in the same jobs.

    Lines are numbered, templates mined and their ids given per file; the rows of all tables begin with ``source_path``.
    """
    if not _files(spark, paths):
        raise ValueError("no file to extract")
    return extract(read_log_lines(spark, paths), config, log="source_path", **options)
