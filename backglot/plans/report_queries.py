"""Registered queries: report sheets, comparison tables, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.operators import fewshot as fs
from backglot.operators import reports, runs
from backglot.operators.reports import LABELS, METRICS, REPORT_HEADERS
from backglot.plans import inputs
from backglot.session import scratch_path
from backglot.sources.tables import read_report_cells, scan, write_report_cells

MODELS = ["Baseline", *(f"src{i}" for i in range(20))]  # of the SQL twin
BLOCK = 200  # rows per fill block: small, so the test tables span many blocks


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def report_header(spark: SparkSession, folder: str) -> DataFrame:
    found = reports.find_headers(inputs.report_cells(spark, folder), "report", "pos", "cells")
    return found.select("report", "header_pos", F.array_join("header", "|").alias("header"))


def report_ffill(spark: SparkSession, folder: str) -> DataFrame:
    cells = inputs.report_cells(spark, folder)
    rows = reports.apply_header(cells, "report", "pos", "cells", ["Language"])
    rows = rows.withColumn("language", F.nullif(F.col("Language"), F.lit("")))
    return reports.forward_fill(rows, "report", "pos", "language", BLOCK)


def model_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.model_report(inputs.report_cells(spark, folder), "report", "pos", "cells", BLOCK), METRICS)


def model_report_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same report from sheets in files: header and row order are found in the files."""
    path = scratch_path(spark, "sheets")
    write_report_cells(inputs.report_cells(spark, folder), "report", "pos", "cells", len(inputs.HEADER), path)
    cells = read_report_cells(spark, f"{path}/report=*")
    cells = cells.withColumn("report", F.regexp_extract("report", "report=([^/]+)", 1))
    rows = reports.model_report(cells, "report", "pos", "cells", BLOCK)
    return _rounded(rows.drop("pos"), METRICS)


def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    language = F.concat("lang", F.lit(" ("), F.upper("lang"), F.lit(")")).alias("Language")
    cells = [
        F.concat(F.lit("0,"), (F.max("n_chars") % m).cast("string"), F.lit(",")).alias(h)
        for m, h in zip(range(89, 95), REPORT_HEADERS)
    ]
    raw = scan(spark, folder, "documents").groupBy(language).agg(*cells)
    return reports.baseline_report(raw, "Baseline")


def baseline_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_baseline(spark, folder), METRICS)


def _comparison(spark: SparkSession, folder: str) -> DataFrame:
    return reports.comparison_set(_baseline(spark, folder), inputs.scores(spark, folder), "pos")


def comparison_set(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_comparison(spark, folder), METRICS)


def model_average(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.model_average(_comparison(spark, folder)), ["overall"])


def metric_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.metric_profile(inputs.scores(spark, folder)), METRICS)


def language_model_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """All models that occur; those of ``MODELS`` that do not are null, so small tables give the same columns."""
    found = reports.language_model_pivot(_comparison(spark, folder))
    found = found.withColumns({m: F.lit(None).cast("double") for m in MODELS if m not in found.columns})
    return _rounded(found, MODELS)


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.scores(spark, folder).withColumn("language_display", F.substring_index("language", " ", 1))
    return _rounded(reports.metrics_long(rows, ["pos", "model", "language_display"]), ["score"])


def learning_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.learning_curve(inputs.scores(spark, folder)), ["overall"])


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    cells = scan(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("stage1_samples"))
    return fs.sweep_grid(cells, "stage1_samples").drop("stage1_samples")


def _done(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with output: one per labelled document, its quality naming the few-shot size."""
    labelled = scan(spark, folder, "labels").join(scan(spark, folder, "documents").select("doc_id", "source", "lang"), "doc_id")
    return labelled.select("source", "lang", (F.col("quality").cast("long") * 5).alias("chunk_size"))


KEYS = ["source", "lang", "chunk_size"]


def missing_cells(spark: SparkSession, folder: str) -> DataFrame:
    return runs.missing_cells(_grid(spark, folder), _done(spark, folder), KEYS)


def resume_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Write the done cells, compute the missing ones, then force the size-0 cells again."""
    path, keys = scratch_path(spark, "cells"), ["lang", "chunk_size"]
    grid, done = (df.select(*keys).distinct() for df in (_grid(spark, folder), _done(spark, folder)))
    runs.write_cells(done.withColumn("state", F.lit("done")), path, keys)
    runs.write_cells(runs.skip_done(grid, path, keys).withColumn("state", F.lit("new")), path, keys)
    zero = runs.skip_done(grid, path, keys, force=True).where(F.col("chunk_size") == 0)
    runs.write_cells(zero.withColumn("state", F.lit("forced")), path, keys)
    table = spark.read.parquet(path)
    return table.select("lang", F.col("chunk_size").cast("long").alias("chunk_size"), "state")


R6 = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
CELL_NUMBER = "CAST(replace(replace({}, chr(10), ''), ',', '.') AS DOUBLE)"
BODY = """body AS (
  SELECT report, pos, cells, last_value(nullif(cells[1], '') IGNORE NULLS) OVER (
    PARTITION BY report ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
  FROM sheets WHERE pos > 1)"""
BASELINE_SQL = f"""baseline AS (
  SELECT 'Baseline' AS model, language, 30.0::DOUBLE AS examples,
    {", ".join(f"CAST(rtrim(replace({m}, ',', '.'), '.') AS DOUBLE) AS {m}" for m in METRICS)}
  FROM (SELECT lang || ' (' || upper(lang) || ')' AS language,
    {", ".join(f"'0,' || (max(n_chars) % {d}) || ',' AS {m}" for d, m in zip(range(89, 95), METRICS))}
    FROM documents GROUP BY lang))"""
COMPARISON = f"""{inputs.SCORES}, {BASELINE_SQL}, comparison AS (
  SELECT *, trim(regexp_replace(language, '\\(.*\\)', '')) AS language_display FROM (
    SELECT model, language, examples, {", ".join(METRICS)} FROM baseline
    UNION ALL SELECT model, language, examples, {", ".join(METRICS)} FROM (
      SELECT *, row_number() OVER (PARTITION BY model, language ORDER BY pos) AS r FROM scores WHERE examples = 0) WHERE r = 1))"""
GRID_SQL = """grid AS (SELECT DISTINCT source, lang, least(k, n) AS chunk_size
  FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), (SELECT unnest([0, 5, 10, 15, 25]) AS k)),
done AS (SELECT DISTINCT source, lang, CAST(quality * 5 AS BIGINT) AS chunk_size FROM labels JOIN documents USING (doc_id))"""

QUERIES = {
    "report_header": (
        report_header,
        f"""WITH {inputs.REPORT} SELECT report, min(pos) AS header_pos, array_to_string(arg_min(cells, pos), '|') AS header
FROM sheets WHERE list_contains(cells, 'Language') AND list_contains(cells, 'No of Examples') GROUP BY report""",
    ),
    "report_ffill": (report_ffill, f"WITH {inputs.REPORT}, {BODY} SELECT report, pos, filled AS language FROM body"),
    "model_report": (
        model_report,
        f"""WITH {inputs.REPORT}, {BODY} SELECT report AS model, pos, filled AS language, CAST(cells[2] AS DOUBLE) AS examples,
  {", ".join(f"round({CELL_NUMBER.format(f'cells[{i}]')}, 6) AS {m}" for i, m in enumerate(METRICS, 3))}
FROM body WHERE cells[2] IS NOT NULL""",
    ),
    "model_report_files": (
        model_report_files,
        f"""WITH {inputs.REPORT}, {BODY} SELECT report AS model, filled AS language, CAST(cells[2] AS DOUBLE) AS examples,
  {", ".join(f"round({CELL_NUMBER.format(f'cells[{i}]')}, 6) AS {m}" for i, m in enumerate(METRICS, 3))}
FROM body WHERE cells[2] IS NOT NULL""",
    ),
    "baseline_report": (baseline_report, f"WITH {BASELINE_SQL} SELECT model, language, examples, {R6} FROM baseline"),
    "comparison_set": (
        comparison_set,
        f"WITH {COMPARISON} SELECT model, language, examples, language_display, {R6} FROM comparison",
    ),
    "model_average": (
        model_average,
        f"WITH {COMPARISON} SELECT model, round(avg(overall), 6) AS overall FROM comparison GROUP BY model",
    ),
    "metric_profile": (
        metric_profile,
        f"""WITH {inputs.SCORES} SELECT model, {", ".join(
            f"round(avg({m}){' / 100' if m == 'syntax_valid_rate' else ''}, 6) AS {m}" for m in METRICS)}
FROM scores GROUP BY model""",
    ),
    "language_model_pivot": (
        language_model_pivot,
        f"""WITH {COMPARISON} SELECT language_display, {", ".join(
            f"round(avg(overall) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS)}
FROM comparison GROUP BY language_display""",
    ),
    "metrics_long": (
        metrics_long,
        f"WITH {inputs.SCORES} "
        + " UNION ALL ".join(
            f"SELECT pos, model, split_part(language, ' ', 1) AS language_display, '{label}' AS metric, "
            f"round({m}{' / 100' if m == 'syntax_valid_rate' else ''}, 6) AS score FROM scores"
            for m, label in zip(METRICS, LABELS)
        ),
    ),
    "learning_curve": (
        learning_curve,
        f"""WITH {inputs.SCORES} SELECT language, examples, model, round(avg(overall), 6) AS overall FROM scores
WHERE language IN (SELECT language FROM scores GROUP BY language HAVING count(DISTINCT examples) > 1)
GROUP BY language, examples, model""",
    ),
    "missing_cells": (
        missing_cells,
        f"WITH {GRID_SQL} SELECT source, lang, chunk_size FROM grid ANTI JOIN done USING (source, lang, chunk_size)",
    ),
    "resume_cells": (
        resume_cells,
        f"""WITH {GRID_SQL} SELECT lang, chunk_size,
  CASE WHEN chunk_size = 0 AND g IS NOT NULL THEN 'forced' WHEN d IS NOT NULL THEN 'done' ELSE 'new' END AS state
FROM (SELECT DISTINCT lang, chunk_size, 1 AS d FROM done) FULL JOIN (SELECT DISTINCT lang, chunk_size, 1 AS g FROM grid)
  USING (lang, chunk_size)""",
    ),
}
