"""Staged runs: a graph of stages over cells, each with a result table and a ledger of finished cells.

A stage writes its table first (dynamic overwrite, one partition per cell) and then records its cells in the ledger. A run
that is killed in between writes the same partitions again; a run that is killed between stages goes on at the first
missing cell. Recomputed cells make later stages recompute what hangs on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from backglot.operators.runs import skip_done, write_cells
from backglot.sources.tables import hand_over, step


@dataclass(frozen=True)
class Stage:
    """``build(cells, *tables)`` makes the rows of ``cells`` from the tables of the stages that it ``needs``."""

    name: str
    keys: tuple[str, ...]
    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def restrict(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of the cells that share their keys with ``cells``; the cells are few and prune partitions."""
    keys = [c for c in cells.columns if c in rows.columns]
    wanted = cells.select(*[F.col(k).alias(f"_cell_{k}") for k in keys]).distinct()
    return rows.join(wanted, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_cell_{k}")) for k in keys]), "left_semi")


class StagedRun:
    """Stages over a ``grid`` of cells, below ``folder``. Stages are given in an order in which they can run."""

    def __init__(self, spark: SparkSession, folder: str, grid: DataFrame, stages: list[Stage]):
        self.spark, self.folder, self.grid = spark, folder, grid
        self.stages = {stage.name: stage for stage in stages}

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        """Result rows of a finished stage, with the types they were written with."""
        schema = self.spark.read.parquet(f"{self._path(name)}-schema").schema
        return self.spark.read.schema(StructType(schema.fields)).parquet(self._path(name))

    def cells(self, stage: Stage) -> DataFrame:
        return self.grid.select(*stage.keys).distinct()

    def run(self, until: str | None = None, force: Iterable[str] = ()) -> dict[str, int]:
        """Compute the missing cells, stage by stage, up to ``until``; how many each stage had to compute."""
        made, renewed = {}, {}
        for stage in self.stages.values():
            cells = self.cells(stage)
            missing = skip_done(cells, self._path(stage.name), list(stage.keys), stage.name in force)
            for before in stage.needs:
                if before in renewed:
                    missing = missing.unionByName(restrict(cells, renewed[before])).distinct()
            missing = hand_over(missing, "cells")
            made[stage.name] = missing.count()
            if made[stage.name]:
                with step(self.spark):  # what the stage handed over goes once its table is written
                    tables = [restrict(self.table(name), missing) for name in stage.needs]
                    rows = stage.build(missing, *tables)
                    path = self._path(stage.name)
                    self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}-schema")
                    write_cells(rows, path, list(stage.keys), missing)
                renewed[stage.name] = missing
            if stage.name == until:
                break
        return made
