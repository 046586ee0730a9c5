"""Report tables: loading, cleaning, forward fill, comparison, pivots, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backglot.functions.text import clean_number, display_name
from backglot.operators.lookup import lookup_join
from backglot.sources.tables import hand_over

METRICS = ["bleu_score", "syntax_valid_rate", "structure_score", "semantic_score", "token_match", "overall"]
# Report headers of the metrics, in the order above, and their display labels.
REPORT_HEADERS = ["Bleu Score", "Syntax Valid Rate", "Structure Score", "Semantic Scire ", "Token Match", "Overall"]
LABELS = ["BLEU Score", "Syntax Valid Rate", "Structure Score", "Semantic Score", "Token Match", "Overall"]
BASELINE_EXAMPLES = 30  # fixed value: few-shot count given to the baseline report


def evaluation_summary(details: DataFrame, run_key: list[str]) -> DataFrame:
    """One row of means per run; validity as a percentage."""
    return details.groupBy(*run_key).agg(
        F.count(F.lit(1)).alias("total_translations"),
        F.avg("bleu_score").alias("bleu_score"),
        (F.avg(F.col("syntax_valid").cast("double")) * 100).alias("syntax_valid_rate"),
        F.avg("structure_score").alias("structure_score"),
        F.avg("semantic_score").alias("semantic_score"),
        F.avg("token_match").alias("token_match"),
        F.avg("overall_score").alias("overall_score"),
    )


SCORES = ["bleu_score", "syntax_valid", "structure_score", "semantic_score", "token_match", "overall_score"]


def summary_state(details: DataFrame, run_key: list[str]) -> DataFrame:
    """``(run_key, rows, sum_*)``: the summary of a batch of details as a state that adds up with others."""
    sums = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"sum_{c}") for c in SCORES]
    return details.groupBy(*run_key).agg(F.count(F.lit(1)).alias("rows"), *sums)


def merge_states(states: DataFrame, run_key: list[str]) -> DataFrame:
    """One state per run of any number of them; the details are not read again."""
    sums = [F.sum(f"sum_{c}").alias(f"sum_{c}") for c in SCORES]
    return states.groupBy(*run_key).agg(F.sum("rows").alias("rows"), *sums)


def finish_summary(states: DataFrame, run_key: list[str]) -> DataFrame:
    """The columns of :func:`evaluation_summary` from one state per run."""
    mean = lambda c: F.col(f"sum_{c}") / F.col("rows")
    validity = (mean("syntax_valid") * 100).alias("syntax_valid_rate")
    means = [validity if c == "syntax_valid" else mean(c).alias(c) for c in SCORES]
    return states.select(*run_key, F.col("rows").alias("total_translations"), *means)


def find_headers(cells: DataFrame, report: str, pos: str, array: str) -> DataFrame:
    """``(report, header_pos, header)``: the first row holding both marker labels.

    ``cells`` has one string array per raw report row. Combined on the map side, so a
    huge report costs one row per task.
    """
    both = F.array_contains(array, "Language") & F.array_contains(array, "No of Examples")
    found = F.when(both, F.struct(F.col(pos).alias("pos"), F.col(array).alias("header")))
    return cells.groupBy(report).agg(F.min(found).alias("h")).select(
        report,
        F.coalesce(
            F.col("h.pos"), F.raise_error(F.concat(F.lit("no header row in report "), F.col(report).cast("string")))
        ).alias("header_pos"),
        F.col("h.header").alias("header"),
    )


def apply_header(cells: DataFrame, report: str, pos: str, array: str, names: list[str]) -> DataFrame:
    """Rows below each report's header with the named cells as columns."""
    headers = find_headers(cells, report, pos, array)
    joined = lookup_join(cells, headers, report, [pos]).where(F.col(pos) > F.col("header_pos"))

    def cell(name: str) -> Column:
        at = F.array_position(F.transform("header", lambda h: F.trim(h)), name.strip())  # CSV writers may trim cells
        absent = F.raise_error(F.concat(F.lit(f"no column '{name}' in report "), F.col(report).cast("string")))
        return F.get(F.col(array), F.when(at > 0, at - 1).otherwise(absent.cast("bigint")).cast("int"))

    return joined.select(report, pos, *[cell(n).alias(n) for n in names])


def forward_fill(df: DataFrame, group: str, pos: str, column: str, block_rows: int = 100_000) -> DataFrame:
    """Fill nulls of ``column`` with the last value above, per group in ``pos`` order.

    A plain window would put a whole group into one task. Rows are filled inside blocks of ``pos`` in one pass and stored;
    the last row of each block carries its value on to the blocks after it, whose first rows are null. The source is read
    once, and what is carried is one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(pos) / block_rows))
    ordered = Window.partitionBy(group, "_block").orderBy(pos)
    above = ordered.rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.withColumns(
        {column: F.last(column, ignorenulls=True).over(above), "_end": F.lead(F.lit(True)).over(ordered).isNull()}
    )
    stored = hand_over(filled, "filled")
    earlier = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = stored.where("_end").select(F.col(group).alias("_group"), F.col("_block").alias("_at"), F.col(column).alias("_last"))
    carry = ends.select("_group", "_at", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_at"))
    joined = stored.join(carry, same, "left").withColumn(column, F.coalesce(column, "_carry"))
    return joined.drop("_block", "_end", "_group", "_at", "_carry")


def _metric_columns() -> list[Column]:
    return [clean_number(F.col(f"`{h}`")).alias(m) for h, m in zip(REPORT_HEADERS, METRICS)]


def baseline_report(raw: DataFrame, model: str, keep: list[str] = ()) -> DataFrame:
    """Report with one row per language and a fixed example count."""
    return raw.select(
        *keep,
        F.lit(model).alias("model"),
        F.col("Language").alias("language"),
        F.lit(float(BASELINE_EXAMPLES)).alias("examples"),
        *_metric_columns(),
    )


def model_report(cells: DataFrame, report: str, pos: str, array: str, block_rows: int = 100_000) -> DataFrame:
    """Raw sheet to typed rows: find header, fill languages down, drop rows without an example count."""
    rows = apply_header(cells, report, pos, array, ["Language", "No of Examples", *REPORT_HEADERS])
    rows = rows.withColumn("Language", F.nullif(F.col("Language"), F.lit("")))
    filled = forward_fill(rows, report, pos, "Language", block_rows)
    return filled.where(F.col("`No of Examples`").isNotNull()).select(
        F.col(report).alias("model"),
        pos,
        F.col("Language").alias("language"),
        clean_number(F.col("`No of Examples`")).alias("examples"),
        *_metric_columns(),
    )


def comparison_set(baseline: DataFrame, reports: DataFrame, pos: str) -> DataFrame:
    """All baseline rows and, per model and language, the first row without examples."""
    first = F.min_by(F.struct("examples", *METRICS), F.col(pos))
    zero = (
        reports.where(F.col("examples") == 0)
        .groupBy("model", "language")
        .agg(first.alias("r"))
        .select("model", "language", "r.*")
    )
    columns = ["model", "language", "examples", *METRICS]
    both = baseline.select(columns).unionByName(zero.select(columns))
    return both.withColumn("language_display", display_name(F.col("language")))


def model_average(rows: DataFrame, metric: str = "overall") -> DataFrame:
    return rows.groupBy("model").agg(F.avg(metric).alias(metric))


def metric_profile(rows: DataFrame) -> DataFrame:
    """Mean of every metric per model, validity scaled to 0..1."""
    means = [F.avg(m).alias(m) for m in METRICS]
    return rows.groupBy("model").agg(*means).withColumn("syntax_valid_rate", F.col("syntax_valid_rate") / 100)


def language_model_pivot(rows: DataFrame, models: list[str] | None = None, metric: str = "overall") -> DataFrame:
    """Languages down, models across, mean metric. Without ``models`` an extra pass finds all that occur (1,000 at most)."""
    if models is None:
        models = sorted(r[0] for r in rows.where(F.col("model").isNotNull()).select("model").distinct().limit(1_001).collect())
        if len(models) > 1_000:
            raise ValueError("more than 1,000 models to set side by side")
    return rows.groupBy("language_display").pivot("model", models).agg(F.avg(metric))


def metrics_long(rows: DataFrame, ids: list[str]) -> DataFrame:
    """One row per metric with display labels, validity scaled to 0..1."""
    labels = F.create_map(*[F.lit(x) for pair in zip(METRICS, LABELS) for x in pair])
    long = rows.unpivot(ids, METRICS, "metric", "score")
    scaled = F.when(F.col("metric") == "syntax_valid_rate", F.col("score") / 100).otherwise(F.col("score"))
    return long.select(*ids, F.element_at(labels, F.col("metric")).alias("metric"), scaled.alias("score"))


def learning_curve(rows: DataFrame, metric: str = "overall") -> DataFrame:
    """Mean metric by language, example count and model, for languages with several counts.

    Rows are aggregated first; the window only sees the result, a row per sweep cell.
    """
    points = rows.groupBy("language", "examples", "model").agg(F.avg(metric).alias(metric))
    counts = F.size(F.collect_set("examples").over(Window.partitionBy("language")))
    return points.withColumn("_counts", counts).where("_counts > 1").drop("_counts")
