"""Corpus preparation in stages; each stage works on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``, as a plan that may be written, read again or handed on to the next stage as it is. Stages
write intermediate tables in the shared folder named by ``spark.checkpoint.dir`` and delete those that their result doesn't read before they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm.lines import without_boilerplate
from canticle.llm.packing import packed_documents
from canticle.llm.quality import keep_good
from canticle.llm.similar import keep_one_similar
from canticle.llm.substring import replaced_text
from canticle.plans.cut import scope, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or whose host is rejected, go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites carry stay in their first place only."""
    return sized(without_boilerplate(docs).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles or more) stays: the one with the smallest id."""
    return keep_one_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that start in a document with a smaller id go; texts that lose nothing stay as they are."""
    return sized(replaced_text(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece in the training sequences."""
    return packed_documents(docs)


def sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: SQL can't express SimHash, tokens and the packing; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; the result of each but the last is written and read again, and then its other tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        with scope(spark):
            docs = written(function(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
