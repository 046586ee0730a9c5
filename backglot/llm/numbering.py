"""Dense positions inside groups of any size, without a sort in one task, and rows of bounded groups read in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backglot.session import ship_package
from backglot.sources.tables import hand_over


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their dense position in their ``tree`` by ``order``, and ``width``, the rows of the tree."""
    ship_package(rows.sparkSession)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    within = hand_over(ranged.mapInArrow(_count_within, f"{kinds}, part int, place long"), "ranged")
    counts = within.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree",
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("width"),
    )
    placed = within.join(offsets, ["tree", "part"])
    return placed.withColumn("pos", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def _count_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("tree"))
        ends = np.asarray(runs.run_ends)
        starts = np.concatenate([[0], ends[:-1]])
        trees = runs.values
        carried = np.zeros(len(ends), np.int64)
        carried[0] = seen if trees[0].as_py() == last else 0
        place = np.arange(batch.num_rows) - np.repeat(starts - carried, ends - starts)
        last, seen = trees[-1].as_py(), int(place[-1]) + 1
        added = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "place"])


def bounded_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one ``(tree, block)`` after another; blocks are bounded."""
    group, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != key:
                if group:
                    yield group
                group, key = [], (row["tree"], row["block"])
            group.append(row)
    if group:
        yield group
