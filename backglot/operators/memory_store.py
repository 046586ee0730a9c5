"""A translation memory that grows: stored in buckets of its key, with versioned upserts.

The table is bucketed by language pair and phrase, so the newest translations, the demand and look-ups are computed where
its rows lie: only the other side of a join is shuffled. An upsert appends rows of a higher version; the highest version of
a phrase counts, and of several translations in that version the least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.lexing import Lexer
from backglot.operators.lookup import lookup_join
from backglot.operators.memory import answer_of, comment_table, phrase_table
from backglot.sources.tables import hand_over

KEY = ["src", "tgt", "phrase"]
COLUMNS = "src string, tgt string, phrase string, translation string, version bigint"


class MemoryStore:
    """The memory stored at ``path``; ``name`` is its name in the session's catalog."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 200):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def upsert(self, answers: DataFrame, version: int) -> None:
        """Add translations ``(src, tgt, phrase, translation)``; those of higher versions replace earlier ones."""
        rows = answers.where(F.col("phrase").isNotNull()).select(*KEY, "translation").withColumn("version", F.lit(version).cast("long"))
        rows.repartition(self.buckets, *KEY).write.insertInto(self.name)

    def current(self) -> DataFrame:
        """``(src, tgt, phrase, translation)``, one row per phrase, without a shuffle."""
        newest = F.min(F.struct((-F.col("version")).alias("v"), "translation"))
        return self.spark.table(self.name).groupBy(*KEY).agg(newest.alias("n")).select(*KEY, "n.translation")

    def demand(self, df: DataFrame, key: str, text: str, lexer: Lexer) -> DataFrame:
        """``(src, tgt, phrase, uses)``: distinct phrases of words and comments that the memory does not hold."""
        phrases = phrase_table(df, key, text, lexer).select("phrase").unionByName(comment_table(df, key, text, lexer).select("phrase"))
        wanted = self._keyed(phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("uses")), lexer)
        return wanted.join(self.current(), KEY, "left_anti").select(*KEY, "uses")

    def lookup(self, phrases: DataFrame, lexer: Lexer, row_id: list[str]) -> DataFrame:
        """Add ``translated``: the memory's answer for the lexer's languages, or the phrase itself.

        Distinct phrases meet the memory; what was found is joined back to the rows, however often a phrase stands there.
        """
        wanted = self._keyed(phrases.select("phrase").where(F.col("phrase").isNotNull()).distinct(), lexer)
        hits = hand_over(wanted.join(self.current(), KEY).select("phrase", "translation"), "hits")
        joined = lookup_join(phrases, hits, "phrase", row_id)
        return joined.withColumn("translated", answer_of(F.col("phrase"), F.col("translation"))).drop("translation")

    @staticmethod
    def _keyed(phrases: DataFrame, lexer: Lexer) -> DataFrame:
        return phrases.withColumn("src", F.lit(lexer.source)).withColumn("tgt", F.lit(lexer.target))
