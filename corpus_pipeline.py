"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
to the shared folder and read again as the next one's docs. All but the last return the
columns of documents; where a stage changes the text, n_chars follows it. A document that
a stage cuts from, and of which no word is left, goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import has_words, materialize
from tidewatch.llm.jaccard_join import one_of_each
from tidewatch.llm.line_dedup import line_dedup
from tidewatch.llm.packing import packing
from tidewatch.llm.quality_rules import accepted
from tidewatch.llm.queries import table, tokenizer_path
from tidewatch.llm.suffix_dedup import cut_repeats


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are alike to an earlier line; those that lose all their words go."""
    judged = line_dedup(docs)
    return _recount(judged.where((F.col("n_removed") == 0) | has_words("text")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that stand earlier; those that lose all their words go."""
    return _recount(cut_repeats(docs, emptied=False))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("suffix_dedup", substrings), ("packing", pack)]

#: The learned rules, MinHash and the tokenizer can't be stated as SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
