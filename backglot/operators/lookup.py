"""Many-to-one lookups that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backglot.sources.tables import hand_over

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
TASK_ROWS = 1_000_000  # rows of one key that a task should take
HOT_SHARE = 100_000  # a hot key holds at least 1/100,000 of all rows, so at most 100,000 keys are hot


def fits_broadcast(dim: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup table (text columns counted in bytes) against the broadcast bound."""
    width = F.lit(16)
    for field in dim.schema.fields:
        if field.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    n, total = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, row_id: list[str], broadcast: bool | None = None) -> DataFrame:
    """Left join of ``facts`` to a ``dim`` that is unique on ``key``.

    A dim within the measured bound is broadcast. A larger one is shuffled: keys with more than ``TASK_ROWS`` rows are
    found by one pre-aggregated count, their dim rows are copied to as many salts as they have such portions, and their
    fact rows are spread over the salts by ``row_id``. Null keys match nothing, so each gets its own salt and they
    spread evenly.
    """
    if fits_broadcast(dim) if broadcast is None else broadcast:
        return facts.join(F.broadcast(dim), key, "left")

    counts = hand_over(facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") > max(TASK_ROWS, total // HOT_SHARE))
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / TASK_ROWS).alias("_salts")))  # at most HOT_SHARE rows
    spread = F.xxhash64(*row_id)
    salt = F.when(F.col(key).isNull(), spread).when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
    salted = facts.join(hot, key, "left").withColumn("_salt", F.coalesce(salt, F.lit(0).cast("long"))).drop("_salts")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1)
    copied = dim.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted.join(copied, [key, "_salt"], "left").drop("_salt")
