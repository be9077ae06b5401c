"""Registered queries of this subpackage. Each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    contamination,
    fill_middle,
    lang_kernel,
    line_dedup,
    line_frequency,
    mixing,
    prefix_trie,
    production,
    pu_quality,
    run_index,
    secret_scan,
    simhash_anchors,
    toxicity,
    transcripts,
)
from tidemark.llm.common import table
from tidemark.llm.oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]

Run = Callable[[SparkSession, str], DataFrame]


def op1_token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"), production.domain_of_source(F.col("source")))
    return mixing.choose(sized, production.MIX_SHARE, production.MIX_WEIGHTS, production.MIX_SEED, max_epochs=production.MIX_EPOCHS)


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = line_dedup.line_decisions(table(spark, sf_dir, "documents"))
    gone = F.sort_array(F.collect_list(F.when(~F.col("keep"), F.col("line_no"))))
    return decided.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("keep")).alias("n_removed"), gone.alias("removed_lines")
    )


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchors.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.deduplicated(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judged(table(spark, sf_dir, "documents"))


def op8_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.recovered(table(spark, sf_dir, "conversations"))


def op9_confirmed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_kernel.held_out(F.col("doc_id"))
    model = lang_kernel.train(docs.where(~held).select("doc_id", "text", "lang"))
    answered = lang_kernel.predict(docs.select("doc_id", "text"), model)
    return answered.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_beginnings(table(spark, sf_dir, "conversations"))


def op12_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (text, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Run]:
    return {
        "pipeline": pipeline,
        "op1_token_mix": op1_token_mix,
        "op2_fuzzy_lines": op2_fuzzy_lines,
        "op3_benchmark_leaks": op3_benchmark_leaks,
        "op4_run_length_index": op4_run_length_index,
        "op5_pu_quality": op5_pu_quality,
        "op6_line_frequency": op6_line_frequency,
        "op7_simhash_anchors": op7_simhash_anchors,
        "op8_transcript_turns": op8_transcript_turns,
        "op9_confirmed_secrets": op9_confirmed_secrets,
        "op10_string_kernel_language": op10_string_kernel_language,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_ftrl_toxicity": op12_ftrl_toxicity,
        "op13_fill_middle": op13_fill_middle,
    }
