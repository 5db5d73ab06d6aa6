"""A training-text pipeline: five stages over ``documents``, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.bpe import bpe_round_trip
from tallygrain.llm.common import table, unused, written
from tallygrain.llm.decontamination import decontaminate
from tallygrain.llm.language_id import UNDETERMINED, identify_language, train_language_model
from tallygrain.llm.near_dedup import near_duplicates
from tallygrain.llm.pii import redact, train_spans
from tallygrain.session import configure

SIMILARITY = 80  # hundredths of shingles in common from which texts are near duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a text that has letters, and put the likeliest of the known languages in ``lang``.

    Documents without text or letters are rejected, and all where no row names a language to learn from. A text in
    none of these languages counts as the one that it is likeliest in.
    """
    configure(spark)
    model = train_language_model(docs, vocabulary_path=public_tokenizers.path("piece_bpe_32k.model"))
    kept = identify_language(docs, model, lang_col="_lang", score_col="_score").where(F.col("_lang") != UNDETERMINED)
    return kept.select(*[F.col("_lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates.

    Every row is a document of its own, whatever its id: rows that share an id go only if their texts are near
    duplicates, and rows without id are grouped like all others. Of a group the row with the smallest id stays, a
    missing id being the largest; of equal ids the one that comes first.
    """
    configure(spark)
    row = unused("row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(numbered.select(row, "text"), id_col=row, percent=SIMILARITY).select(F.col("doc_id").alias(row), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = numbered.select("doc_id", row).join(written(groups), row).groupBy("component_id").agg(F.min(rank).alias("x"))
    return numbered.join(first.select(F.col(f"x.{row}").alias(row)), row, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    configure(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind, and count characters anew."""
    configure(spark)
    cleaned = redact(docs, train_spans(docs))
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that decoding them gives."""
    configure(spark)
    vocabulary = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return bpe_round_trip(docs, **vocabulary).select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("byte_bpe", byte_bpe),
]

#: Language models, tiling, the random field and the encoder have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage's documents are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
