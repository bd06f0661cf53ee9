"""A training corpus from documents, in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, ngram_join, packing, quality
from tidemark.llm.common import staged
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives a score of 0.3 or more."""
    scores = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.where("score >= 0.3").select("row.*").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat across documents, but for each line's last one; none goes as a whole."""
    return _documents(line_dedup.dedup_lines(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that similar word 5-grams link."""
    return ngram_join.one_row_of_each(docs).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix: a row for each use of a document."""
    return _documents(mixing.mixed_documents(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens stands in the packed sequences."""
    return packing.packed_tokens(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("mix", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL can't express the classifier, banding or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
