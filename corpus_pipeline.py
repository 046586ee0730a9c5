"""The training-data pipeline: its stages in order, each written as a table and read again.

Toxic documents go, one document of each group of near copies stays, repeated passages are cut, documents that hold a
benchmark item go, and what is left is encoded. All stages but the last return the columns of ``documents``; ``n_chars``
follows the text. A null text is a document without words: no stage drops it, and it encodes to no ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm import bpe, decontaminate, neardup, substrings, toxicity
from backglot.sources.tables import hand_over, scan

TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score. The model learns from the labels that op5 may learn from."""
    labels, texts = scan(spark, sf_dir, "labels"), scan(spark, sf_dir, "documents")
    model = toxicity.toxicity_model(texts, labels, ~toxicity.held_out_of(0, 5))
    row = F.struct(*[F.col(c) for c in docs.columns])
    scored = toxicity.score_toxicity(docs.select(row.alias("row"), "text"), model)
    return scored.where(F.col("score") < TOXIC_SCORE).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id; a document without an id is a group of its own."""
    found = neardup.near_duplicates(docs, shingle=5, percent=80)
    gone = hand_over(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a document with a smaller id holds in a run of 13 or more."""
    cut = substrings.remove_repeats(docs, span=13)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    hits = decontaminate.find_items(docs, scan(spark, sf_dir, "benchmark"))
    gone = hand_over(hits.select("doc_id").distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    return bpe.encode_round_trip(docs, bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_texts),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = hand_over(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
