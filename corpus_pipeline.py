"""A training corpus in five stages; each reads the documents its predecessor left, as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm.common import table
from tideframe.llm.jaccard_join import one_of_each_group
from tideframe.llm.language_id import in_known_language
from tideframe.llm.packing import best_fit_packing
from tideframe.llm.quality_rules import passing_rules
from tideframe.llm.suffix_dedup import without_repeats
from tideframe.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return passing_rules(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no recognised language go."""
    return in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts."""
    return without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("language_id", language), ("jaccard_join", near_duplicates), ("suffix_dedup", repeated_passages), ("best_fit_packing", packed)]

#: SQL can express neither a trained stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
