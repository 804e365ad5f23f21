"""The corpus pipeline: quality rules, near-duplicates, decontamination, surrogates, encoding.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of
the next. All stages but the last keep the columns of ``documents``.

Defined cases: a NULL text counts as an empty one; a text of any length is read whole; a row without an
id passes near-duplicates as it is, all other stages treat it like any row; of rows equal in id and text
one stays; further columns of any name are kept up to encoding, which returns its digests alone; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailstrata.llm import bpe, decontaminate, pii, quality, similar
from mailstrata.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8: candidates from the
    vantage-point forest over fingerprints, and from sketches beyond its radius, then the exact similarity."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return pii.anonymize(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, per document."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("encoding", encoding),
]

#: Encoding cannot be expressed in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
