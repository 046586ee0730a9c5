"""Corpus mining: extraction, first-row deduplication, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backglot.functions.text import extract_code


def extract_snippets(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text holds a fenced Python block that looks like code.

    Exploding the zero-or-one result drops the nulls without a filter, which Catalyst
    would push down and thereby run the extraction twice.
    """
    found = F.array_compact(F.array(extract_code(F.col(text))))
    return corpus.select(key, F.explode(found).alias("code"))


def dedup_first(snippets: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Distinct codes, each with its smallest key.

    ``min`` is combined on the map side, so a code that fills a third of the table
    reaches the shuffle as one row per map task.
    """
    return snippets.groupBy(code).agg(F.min(key).alias(key))


def corpus_stats(snippets: DataFrame, code: str = "code") -> DataFrame:
    """Count, exact distinct count, code lengths and nulls in one row.

    The first aggregation keys on a digest, so texts themselves are never shuffled.
    """
    column = F.col(code)
    per_code = snippets.groupBy(F.sha2(column, 256).alias("digest"), F.length(column).alias("size")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    present = F.col("digest").isNotNull()
    return per_code.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_samples"),
        F.count("digest").alias("unique_samples"),
        F.try_divide(
            F.sum(F.when(present, F.col("size") * F.col("copies"))), F.sum(F.when(present, F.col("copies")))
        ).alias("average_code_length"),
        F.min("size").alias("min_code_length"),
        F.max("size").alias("max_code_length"),
        F.coalesce(F.sum(F.when(~present, F.col("copies"))), F.lit(0)).alias("null_values"),
    )


def attrition(corpus: DataFrame, text: str) -> DataFrame:
    """Rows before and after extraction and deduplication, counted in one pass over digests."""
    code = F.sha2(extract_code(F.col(text)), 256)
    per_code = corpus.groupBy(code.alias("digest")).agg(F.count(F.lit(1)).alias("copies"))
    initial, final = F.coalesce(F.sum("copies"), F.lit(0)), F.count("digest")
    return per_code.agg(
        initial.alias("initial_size"), final.alias("final_size"), (initial - final).alias("removed")
    )
