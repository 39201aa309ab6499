"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; ``run`` writes every stage's result as Parquet to the shared folder and
reads it back, so a lost executor never goes back further than one stage.

Defined results: a document with a null, empty or short text breaks a quality
rule and goes; of repeated rows and near copies the first by doc_id stays (ties
by place); null ids are kept as they are; an empty table or benchmark gives no
pieces, or leaves out none; other columns go along unread, whatever their names
(n_chars follows the text where it is there), until packing drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, line_dedup, ngram_join, packing, quality_rules


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.keep(docs)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document of which nothing is left goes. n_chars follows the text."""
    n_lines, n_removed = common.free_name(docs, "n_lines_of_text"), common.free_name(docs, "n_removed_of_text")
    done = line_dedup.dedup_lines(docs, counts=(n_lines, n_removed))
    left = (F.col(n_removed) == 0) | (F.trim(F.translate("text", "\t\n\x0b\f\r", "")) != "")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return common.filter_after(done, left).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.keep_clean(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs).drop("_row")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_copied_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    return docs


#: MinHash banding, tokens and packing are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None
