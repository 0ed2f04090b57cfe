"""From raw documents to packed training sequences."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.llm.common import store
from aftershock.llm.line_dups import drop_repeated_lines
from aftershock.llm.near_dups import one_of_each_component
from aftershock.llm.packing import pack_documents
from aftershock.llm.quality import fit_quality, score_quality
from aftershock.llm.queries import held_out
from aftershock.llm.tokens import encode_documents

TOKENIZER, END_ID, SEQUENCE = "byte_bpe_50k.json", 0, 1024


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a third of the labels stays unseen."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = score_quality(docs, fit_quality(docs, labels), docs.columns)
    return scored.filter("predicted = 1").select(docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one repeats; those left without any text go."""
    cut = drop_repeated_lines(docs).filter("removed_lines = 0 OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, one with the smallest id."""
    return one_of_each_component(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return pack_documents(store(encode_documents(docs, tokenizer_path(TOKENIZER), END_ID), "tokens"), SEQUENCE)


STAGES = [
    ("quality", good_documents),
    ("line_dups", new_lines),
    ("near_dups", one_of_each_group),
    ("packing", packed),
]
# Trained models, signatures and packings have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents, each over what its predecessor stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage-{name}")
    return docs
