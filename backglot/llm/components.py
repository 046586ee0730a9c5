"""Connected components of a large link table, by alternating large-star and small-star rounds.

Every round is a join and two pre-aggregated minima, written to the shared scratch folder, so neither a vertex
with very many links nor a lost executor hurts. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backglot.sources.tables import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every vertex to the least of its neighbourhood (``large``: its larger ones; else the rest)."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where("u != v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``edges(u, v)``: the least id it can reach.

    Links to itself are no links; a table without links gives no rows. The rounds needed grow with the logarithm
    of the longest chain; not reaching the end within ``rounds`` is an error.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    first = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = scratch.keep(first, "links")
    state_of = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
    check = state_of(current)
    for _ in range(rounds):
        last, current = current, scratch.keep(_star(_star(current, True), False), "links")
        scratch.drop(last)
        state = state_of(current)
        if state == check:
            ids = current.select("u").union(current.select("v")).distinct()
            found = ids.join(current.select("u", "v"), "u", "left")
            return found.select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))
        check = state
    raise RuntimeError("components did not settle")
