"""Dense row positions and positional slices."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backglot.operators.runs import STORED
from backglot.session import shuffle_partitions

RANGE_ROWS = 1_000_000  # positions of one stored range
MOST_RANGES = 256  # stored ranges: each is a folder with files of its own


def with_position(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Number rows 0..n-1 in the order of a unique numeric ``key``.

    A global ``row_number`` would sort the whole table in one task. Here rows fall
    into key ranges (bounds from approximate quantiles, so ranges are even however
    the keys are spread), each range is numbered on its own, and a table with one
    count per range supplies the offsets. The bounds are literals, so a lost task
    recomputes to the same numbers.
    """
    parts = max(shuffle_partitions(df.sparkSession), 2)
    probabilities = [i / parts for i in range(1, parts)]
    numeric = df.withColumn("_key", F.col(key).cast("double"))
    bounds = numeric.approxQuantile("_key", probabilities, 0.5 / parts)
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(numeric)
    else:
        ranged = numeric.withColumn("_range", F.lit(0.0))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (
        ranged.withColumn("_within", within)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_offset") + F.col("_within")).cast("long"))
        .drop("_key", "_range", "_within", "_offset")
    )


def store_positions(df: DataFrame, key: str, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Number the rows of ``df`` once and store them by ranges of positions, with the row count beside them.

    A range holds ``range_rows`` positions, or more where a large table would have more than ``MOST_RANGES`` ranges.
    """
    range_rows = max(range_rows, -(-df.count() // MOST_RANGES))
    placed = with_position(df, key).withColumn("pos_range", F.floor(F.col("pos") / range_rows).cast("long"))
    placed.hint("rebalance", "pos_range").write.mode("overwrite").option("compression", STORED).partitionBy("pos_range").parquet(path)
    spark = df.sparkSession
    empty = spark.createDataFrame([], placed.schema)
    stored = spark.read.schema(empty.schema).parquet(path)
    total = stored.agg(F.count(F.lit(1)).alias("total"), F.lit(range_rows).cast("long").alias("range_rows"))
    empty.write.mode("overwrite").parquet(f"{path}-schema")
    total.write.mode("overwrite").parquet(f"{path}-total")


def stored_slice(spark: SparkSession, path: str, start: int, size: int) -> DataFrame:
    """Rows ``[start, start+size)`` of a stored table, from 0 if they run over the end; ``row`` counts within the slice.

    The bounds are literals on the partition column, so only the files of the slice are listed and read.
    """
    total, range_rows = spark.read.parquet(f"{path}-total").first()
    begin = 0 if start + size > total else start
    rows = spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)
    inside = rows.where(F.col("pos_range").between(begin // range_rows, max(begin + size - 1, 0) // range_rows))
    inside = inside.where((F.col("pos") >= begin) & (F.col("pos") < begin + size))
    return inside.withColumn("row", F.col("pos") - begin).drop("pos_range")


def row_total(df: DataFrame) -> Column:
    """Row count as a scalar subquery column."""
    return df.agg(F.count(F.lit(1))).scalar()


def slice_rows(positioned: DataFrame, start: Column, size: Column, total: Column) -> DataFrame:
    """Rows ``[start, start+size)``; a slice that runs over the end starts at 0 instead."""
    begin = F.when(start + size > total, F.lit(0)).otherwise(start)
    return positioned.where((F.col("pos") >= begin) & (F.col("pos") < begin + size))


def stage1_rows(positioned: DataFrame, size: Column) -> DataFrame:
    return positioned.where(F.col("pos") < size)


def stage2_rows(positioned: DataFrame, start: Column, stage1: Column, stage2: Column) -> DataFrame:
    """The held-out rows right after the stage-1 rows."""
    begin = start + stage1
    return positioned.where((F.col("pos") >= begin) & (F.col("pos") < begin + stage2))


def first_rows(df: DataFrame, key: str, size: int) -> DataFrame:
    """The first few rows in key order (per-partition top-k, no full sort)."""
    return df.orderBy(key).limit(size)
