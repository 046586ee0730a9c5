"""Incremental runs: missing work, forced recompute, run keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STORED = "zstd"  # compression of tables that stay: texts take about two thirds of what snappy makes of them


def missing_cells(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells without output, a null key being a value like any other. ``done`` is reduced to distinct keys first."""
    there = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]
    return grid.join(there, reduce(and_, same), "left_anti")


def existing_cells(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """Cells that are done, with the types they had when written; None when nothing was written yet."""
    try:
        return spark.read.parquet(f"{path}-cells").select(*keys).distinct()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_cells(df: DataFrame, path: str, keys: list[str], cells: DataFrame | None = None) -> None:
    """Write a result table by run key, replacing exactly the cells present in ``df``.

    ``cells`` are the cells that were computed (those of ``df`` by default). They are recorded beside the table, so a
    cell without result rows is done as well. Rebalancing gathers a cell's rows into few files, yet splits a cell that
    holds a large share of all rows.
    """
    writer = df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", STORED).partitionBy(*keys).parquet(path)
    if cells is None:  # from the partitions, which hold nothing but cells that are done
        cells = df.sparkSession.read.schema(df.schema).parquet(path)
    cells.select(*keys).distinct().write.mode("append").parquet(f"{path}-cells")


def skip_done(grid: DataFrame, path: str, keys: list[str], force: bool = False) -> DataFrame:
    """Cells to compute now: all when forced, otherwise those the table lacks."""
    done = None if force else existing_cells(grid.sparkSession, path, keys)
    return grid if done is None else missing_cells(grid, done, keys)


# How a result file name spells its run.
RUN_NAME = (
    r"^(partial_translation|Stage_1|Stage_2|partial_back_translation|Final_back_translation|final_back_translation"
    r"|evaluation_details|evaluation_summary)_(?:([a-z][a-z0-9]*)_)?([a-z]{2}(?:-[A-Z]{2})?)_([a-z]{2}(?:-[A-Z]{2})?)"
    r"((?:_\d+)+)\.(csv|json)$"
)


def run_key(name: Column) -> list[Column]:
    """Columns of the run key in a file name: kind, model, languages, counts."""

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(name, RUN_NAME, group), F.lit(""))

    kind = part(1)
    counts = F.split(F.substr(part(5), F.lit(2)), "_").cast("array<long>")
    size = F.size(counts)

    def at(index: int, when: Column) -> Column:
        return F.when(when, F.get(counts, F.lit(index) if index >= 0 else size + index))

    full = size >= 3  # start, stage-1 rows, stage-2 rows
    stage1_only = (size == 1) & kind.isin("partial_back_translation")
    return [
        kind.alias("kind"),
        part(2).alias("model"),
        part(3).alias("source_lang"),
        part(4).alias("target_lang"),
        at(0, full).alias("start_index"),
        F.coalesce(at(1, full), at(0, stage1_only)).alias("stage1_samples"),
        F.coalesce(at(2, full), at(0, size == 2)).alias("stage2_samples"),
        F.coalesce(at(3, size == 4), at(1, size == 2), at(0, (size == 1) & ~stage1_only)).alias("chunk_size"),
    ]
