"""Keyword tables and bidirectional dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backglot.functions.languages import LANGUAGES, keyword_header
from backglot.functions.text import strip


def keyword_table(wide: DataFrame, row_no: str) -> DataFrame:
    """Wide keyword table (one column per language) to ``(row_no, lang, word)``."""
    codes = {header: code for code, header, _ in LANGUAGES}
    present = [c for c in wide.columns if c in codes]
    long = wide.unpivot([row_no], present, "header", "word").where(F.col("word").isNotNull())
    lang = F.create_map(*[F.lit(x) for header in present for x in (header, codes[header])])
    return long.select(row_no, F.element_at(lang, F.col("header")).alias("lang"), "word")


def wide_pair(wide: DataFrame, row_no: str, source: str, target: str) -> DataFrame:
    """The two language columns of a wide keyword table as ``(row_no, src, tgt)``."""
    return wide.select(
        row_no, F.col(keyword_header(source)).alias("src"), F.col(keyword_header(target)).alias("tgt")
    )


def keyword_dictionary(pairs: DataFrame, order: Column) -> DataFrame:
    """``(src, tgt)`` rows to a unique ``(word, repl)`` map that works both ways.

    Later rows overwrite earlier ones, and within a row the reverse entry is written
    last. ``max_by`` combines on the map side.
    """
    clean = pairs.select(order.alias("row"), strip(F.col("src")).alias("src"), strip(F.col("tgt")).alias("tgt")).where(
        F.col("src").isNotNull() & F.col("tgt").isNotNull()
    )
    forward = clean.select("row", F.lit(0).alias("side"), F.col("src").alias("word"), F.col("tgt").alias("repl"))
    reverse = clean.select("row", F.lit(1).alias("side"), F.col("tgt").alias("word"), F.col("src").alias("repl"))
    return forward.unionByName(reverse).groupBy("word").agg(F.max_by("repl", F.struct("row", "side")).alias("repl"))


def collisions(pairs: DataFrame) -> DataFrame:
    """Words with more than one candidate replacement, which the dictionary has to drop."""
    both = pairs.select(F.col("src").alias("word"), F.col("tgt").alias("repl")).unionByName(
        pairs.select(F.col("tgt").alias("word"), F.col("src").alias("repl"))
    )
    return both.groupBy("word").agg(F.countDistinct("repl").alias("candidates")).where("candidates > 1")
