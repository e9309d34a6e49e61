"""A training corpus from raw documents: reject, deduplicate, cut repeats, sanitise, pack.

``STAGES`` holds (name, function) pairs in order. A function takes ``(spark, docs, sf_dir)``; all but the last
return the columns of documents, and each works on all that its predecessor kept. ``run`` writes the result of
every stage as Parquet to the shared folder and reads it again for the next one.

A language model and a packing cannot be stated in SQL, so ``ORACLE_SQL`` is None; tests compare the stages
with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import jaccard, language, packing, pii, substrings
from logweave.llm.common import release, stored, table

#: Below this mean probability no language is accepted.
MIN_SCORE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the new text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language the network knows, go."""
    found = language.identify(docs)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return jaccard.one_per_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document keeps its row."""
    return _measured(substrings.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, disclosing terms are generalised or removed."""
    return _measured(pii.sanitise(docs))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence, with its token ids.

    Workers are shared with the other stages, so they keep few words.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kept_words=50_000)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("retrieval_packing", retrieval_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
