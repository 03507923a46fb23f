"""From raw documents to packed training sequences: five stages, each written before the next one reads it.

1. quality rules: documents that policy ``v2`` rejects go;
2. line dedup: lines that repeat an earlier line go, and with them documents that keep no line;
3. n-gram Jaccard join: of each group of near-duplicates the document with the smallest id stays;
4. secret scan: secrets are blotted out;
5. best-fit packing: the place of every piece of every document in sequences of 2048 tokens.

All stages but the last return the columns of ``documents``; ``n_chars``, where present, follows the text.
Null texts have no words and go in the first stage. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import jaccard, lines, packing, quality, secrets
from fieldmark.llm.frames import fresh
from fieldmark.sources.staging import stage

CAPACITY = 2_048
TOKENIZER = "word_bpe_49k.json"
RULE_VERSION = 2


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` whose ``n_chars`` is the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (ledger,) = fresh(docs, "ledger")
    # The ledger is written once; policies then read its bits.
    rows = stage(quality.add_ledger(docs, out=ledger))
    return rows.where(quality.apply_policy(F.col(f"{ledger}.bits"), "v2")).drop(ledger)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (removed,) = fresh(docs, "removed")
    rows = lines.drop_repeated_lines(docs, least_words=1, out=removed)
    left = (F.size(removed) == 0) | (F.btrim("text", F.lit(lines.SPACES)) != "")
    return counted(rows.where(left).drop(removed))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secrets.build_ledger(docs, RULE_VERSION)
    return counted(secrets.redact_found(docs, ledger, RULE_VERSION))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(docs, public_tokenizers.path(TOKENIZER), CAPACITY)
    return packing.pack(pieces, CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizing and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, function) in enumerate(STAGES, start=1):
        docs = function(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = stage(docs)
    return docs
