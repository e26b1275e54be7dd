"""A training corpus from ``documents``: five stages, each over all that the one
before it kept, with its result stored and read again.

Copies are dropped by row, whatever their ids; the stages after that take ids to be
unique, and rows without id pass them untouched by their links.

A stage begins by deleting what earlier stages wrote on their way, as its input is the
stored result of the one before: results of two stages are never pending at once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.llm import exact_dedup, ngram_join, packing, scratch, substring_dedup, toxicity
from orderlytics.llm.registry import fold

#: Shingles and similarity (per cent) of near copies.
WORDS, PERCENT = 5, 80
#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids``."""
    return docs.join(scratch.bounded(scratch.table(ids)), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    scratch.release(spark, docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels, fold(3) != 1, keep=tuple(docs.columns))
    return scored.where(F.col("score") < TOXIC).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of equal texts: of rows
    repeated with one id, and of copies without id, one too."""
    scratch.release(spark, docs)
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    scratch.release(spark, docs)
    found = ngram_join.ngram_components(docs, WORDS, PERCENT)
    return _without(docs, found.where("component_id <> doc_id").select("doc_id").distinct())


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those made of such
    passages alone go. n_chars is that of the text left."""
    scratch.release(spark, docs)
    spans = scratch.table(substring_dedup.passages(docs))
    return substring_dedup.without_passages(docs, spans).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    scratch.release(spark, docs)
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(scratch.table(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies),
          ("substring_dedup", cut_passages), ("packing", pack)]

#: Learnt scores, chains and packing are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        last, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(*(df for df in [last] if "scratch_path" in vars(df)))
    return STAGES[-1][1](spark, docs, sf_dir)
