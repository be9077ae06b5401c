"""From raw documents to a training mix: five stages, each written to Parquet and read again by the next.

    STAGES   (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame
    run      applies them to the given documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, lang_kernel, line_dedup, mixing, production, simhash_anchors
from tidemark.llm.common import stored, table

# The language model, line groups found by MinHash and fingerprints of texts have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; texts without a letter go."""
    return lang_kernel.recognised(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines in all documents, the first line stays."""
    return line_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies, the document with the smallest doc_id stays."""
    return simhash_anchors.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row per epoch, with ``mix_epoch``."""
    return mixing.mixed(
        docs,
        production.domain_of_source(F.col("source")),
        production.MIX_SHARE,
        production.MIX_WEIGHTS,
        production.MIX_SEED,
        production.MIX_EPOCHS,
    )


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
