"""Readers and writers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.operators.runs import run_key
from backglot.session import scratch_path, shuffle_partitions

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"'}
STATS_SCHEMA = (
    "total_samples double, unique_samples double, average_code_length double, "
    "min_code_length double, max_code_length double, null_values double"
)
SUMMARY_SCHEMA = (
    "chunk_size long, total_translations long, bleu_score double, syntax_valid_rate double, "
    "structure_score double, semantic_score double, token_match double, overall_score double"
)


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw corpus without its prompt columns; the scan never reads them."""
    corpus = spark.read.parquet(path)
    return corpus.drop("instruction", "system")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with quoted line breaks and doubled quotes. One task per file: convert to parquet at ingest."""
    reader = spark.read.options(**CSV_OPTIONS)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_report_cells(spark: SparkSession, path: str) -> DataFrame:
    """Header-less report sheets as ``(report, pos, cells)``; every sheet is one file and one task."""
    raw = spark.read.options(multiLine=True, escape='"', header=False).csv(path)
    cells = F.array(*[F.col(c) for c in raw.columns])
    return raw.select(
        F.input_file_name().alias("report"), F.monotonically_increasing_id().alias("pos"), cells.alias("cells")
    )


def write_report_cells(cells: DataFrame, report: str, pos: str, array: str, width: int, path: str) -> None:
    """Report sheets as header-less CSV files, one folder and file per report, rows in ``pos`` order."""
    named = [F.get(array, F.lit(i)).alias(f"c{i}") for i in range(width)]
    dealt = cells.repartition(report).sortWithinPartitions(report, pos).select(report, *named)
    dealt.write.partitionBy(report).options(header=False, escape='"', quoteAll=True, ignoreTrailingWhiteSpace=False).csv(path)


def read_summaries(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """Evaluation summaries with the run key taken from the file name.

    ``multi_line`` reads one indented object per file instead of one object per line.
    """
    rows = spark.read.schema(SUMMARY_SCHEMA).json(paths, multiLine=multi_line)
    key = [c for c in run_key(F.col("_metadata.file_name"))][:4]
    return rows.select(*key, *[F.col(c) for c in rows.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', quoteAll=True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write a stage result to the shared scratch folder and continue from the table.

    Later stages read it as often as they like without recomputing the earlier ones,
    and a lost executor costs a re-read, not the lineage. The table is deleted when the :func:`step` or the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _delete_on_exit(spark, path)
    delete_after(path)
    return spark.read.schema(df.schema).parquet(path)


def hand_over_keyed(df: DataFrame, key: str) -> DataFrame:
    """Like :func:`hand_over`, dealt and bucketed by ``key``: aggregations and joins by the key read it without a shuffle."""
    spark = df.sparkSession
    path, buckets = scratch_path(spark, "keyed"), shuffle_partitions(spark)
    name = os.path.basename(path).replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    _delete_on_exit(spark, path)
    return spark.table(name)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_STEPS: list[list[str]] = []  # of every step under way: the folders that go at its end


def delete_after(*paths: str) -> None:
    """Folders to delete at the end of the innermost :func:`step`; without one they stay."""
    if _STEPS:
        _STEPS[-1].extend(paths)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """A step whose results are written inside: at its end, the tables handed over in it are deleted.

    The shuffle files of a query go when the query ends, not when the driver happens to collect its garbage. No DataFrame
    made inside may be read after it. A step that fails leaves its tables until the application ends.
    """
    kept = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    _STEPS.append([])
    done = False
    try:
        yield
        done = True
    finally:
        paths = _STEPS.pop()
        if kept is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, kept)
        if done:
            for path in paths:
                _delete(spark, path)


class Scratch:
    """The scratch tables of one query: each is dropped once the tables made from it are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        _delete_on_exit(self.spark, path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(stored)] = (stored, path)
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of :meth:`keep`; nothing may read them, or a DataFrame made from them, any more."""
        for table in tables:
            _, path = self.tables.pop(id(table))
            _delete(self.spark, path)

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but ``kept``: those that the query's result reads."""
        names = {id(table) for table in kept}
        self.drop(*[table for table, _ in list(self.tables.values()) if id(table) not in names])


def stored_stats(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Corpus statistics from the JSON at ``path``; computed and written there when no write finished or ``force``d."""
    if force or not exists(spark, os.path.join(path, "_SUCCESS")):
        write_json(compute(), path)
    return spark.read.schema(STATS_SCHEMA).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_table(df: DataFrame, path: str, partitions: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
