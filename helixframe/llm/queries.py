"""The corpus operators as queries over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, mixing, packing, quality_classifier, quality_rules, secrets, simhash, tool_calls, toxicity, url_filter
from helixframe.llm.common import id_remainder
from helixframe.plans.queries import spread

URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_power_of_two(
        _table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), max_length=1024, end_id=0, with_ids=False
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit_quality(docs, _table(spark, sf_dir, "labels"), id_remainder("doc_id", 4) != 2)
    scored = quality_classifier.score_quality(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_tool_calls(_table(spark, sf_dir, "conversations"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, max_distance=2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, max_repeats=2.0)
    return mixing.taken_words(mixture).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing,
        op2_quality_classifier,
        op3_url_filter,
        op4_tool_calls,
        op5_secrets,
        op6_quality_rules,
        op7_simhash,
        op8_exact_dedup,
        op9_toxicity,
        op10_mixing,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Models, schedules, fingerprints and tokenizers have no SQL form; tests hold those against brute force."""
    return {
        "op8_exact_dedup": r"""
            WITH n AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
            )
            SELECT doc_id,
                   min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
                   sha256(norm) AS text_sha256
            FROM n
        """,
    }
