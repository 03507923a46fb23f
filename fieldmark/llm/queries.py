"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import (
    jaccard, lines, multi_index, packing, pieces, quality, resampling, secrets, sharding, suffix, tokens, toxicity, whitening,
)

CAPACITY = 2_048
TOKEN_LIMIT = 512
SHARDS = 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "toxicity.*")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = suffix.remove_repeats(docs, length=400)
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"]
    )
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeat"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return packing.pack(cut, CAPACITY)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.add_ledger(docs).select("doc_id", "ledger.*")
    base = quality.apply_policy(F.col("bits"), "base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"),
        (base & quality.apply_policy(F.col("bits"), "v2")).alias("kept"),
        "n_lines", "bits",
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.build_ledger(docs, rule_version=2)
    rows = secrets.join_findings(docs, ledger, rule_version=2)
    return rows.select(
        "doc_id",
        *(secrets.count_kind("spans", kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.listed("spans", secrets.BASE).cast("binary"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, size=5, percent=75)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("before", F.size(F.split("text", "\n")))
    rows = lines.drop_repeated_lines(counted, least_words=1, out="removed")
    return rows.select(
        "doc_id", F.coalesce("before", F.lit(0)).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resampling.resample(docs, target, percent=5, least_words=20, buckets=10_000, seed=42)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.equal_shards(read(spark, sf_dir, "documents"), SHARDS)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read(spark, sf_dir, "embeddings"), components=32)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


REGISTERED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_toxicity,
    op2_multi_index,
    op3_suffix_dedup,
    op4_best_fit_packing,
    op5_token_counts,
    op6_quality_rules,
    op7_secret_scan,
    op8_ngram_jaccard,
    op9_line_dedup,
    op10_sentence_pieces,
    op11_importance_resampling,
    op12_sharding,
    op13_whitening,
)
