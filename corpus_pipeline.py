"""The corpus pipeline: five stages over ``documents``, each on all rows that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it as the next stage's ``docs``. All stages but the
last return the columns of ``documents``. Null texts are kept where a stage has no reason
to remove them; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, line_dedup, near_dedup, piece_dropout, quality_classifier
from docweave.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It learns from the stage's own documents that have labels."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.filter_quality(docs, model).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated line runs, n_chars anew; a document that loses all its words goes."""
    out = line_dedup.dedup_lines(docs)
    out = out.where("n_deleted = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id (a null one last), of each group of near duplicates (similarity 0.8 on five-word shingles).

    Rows are judged one by one: of repeated rows one stays, different texts of one id are
    documents of their own. Rows without words are in no group and stay.
    """
    numbered = stored(docs.select(*COLUMNS).withColumn("number", F.monotonically_increasing_id()), "pipeline-rows")
    groups = near_dedup.near_duplicates(numbered, id_col="number").select(F.col("doc_id").alias("number"), "component_id")
    ranked = groups.join(numbered.select("number", "doc_id"), "number").select("component_id", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "number").alias("place"))
    first = ranked.groupBy("component_id").agg(F.min("place").alias("place")).select("place.number")
    return numbered.join(first, "number", "left_semi").select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated with benchmark items, each judged by its own text."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where("not contaminated").select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the checksum of what they decode to."""
    return piece_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "variant", "n_pieces", "piece_ids", "ids_crc32", F.col("decoded_crc32").alias("text_crc32"), "lossless")


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate_benchmark),
    ("SentencePiece encoding", encode_pieces),
]

#: SQL cannot express a trained model, a hashed dropout or components of near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
