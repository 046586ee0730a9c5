"""Registered queries: corpus mining, slices, positions, cells, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.text import clean_number, display_name, extract_code, fenced_block, has_code_keyword
from backglot.operators import corpus, positions
from backglot.operators.runs import run_key
from backglot.plans import inputs
from backglot.plans import sqltext as q
from backglot.sources import tables
from backglot.session import scratch_path

FENCE_SQL = "regexp_extract(output, '(?s)```python(.*?)```', 1)"
HAS_FENCE = "regexp_matches(output, '(?s)```python(.*?)```')"
KEYWORD_SQL = " OR ".join(f"contains(code, '{k}')" for k in ["def ", "class ", "import ", "print", "for", "while"])
BLOCKS = f"{inputs.FENCED}, blocks AS (SELECT doc_id, CASE WHEN {HAS_FENCE} THEN {q.strip(FENCE_SQL)} END AS code FROM fenced)"
SNIPPETS = f"{BLOCKS}, snippets AS (SELECT doc_id, code FROM blocks WHERE {KEYWORD_SQL})"


def extract_fenced(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.fenced(spark, folder).select("doc_id", fenced_block(F.col("output")).alias("code"))


def keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    code = fenced_block(F.col("output"))
    rows = inputs.fenced(spark, folder).select("doc_id", code.alias("code")).where(F.col("code").isNotNull())
    return rows.select("doc_id", has_code_keyword(F.col("code")).alias("is_code"))


def dedup_snippets(spark: SparkSession, folder: str) -> DataFrame:
    snippets = corpus.extract_snippets(inputs.fenced(spark, folder), "doc_id", "output")
    return corpus.dedup_first(snippets, "doc_id")


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.fenced(spark, folder).select(extract_code(F.col("output")).alias("code"))
    stats = corpus.corpus_stats(rows)
    return stats.withColumn("average_code_length", F.round("average_code_length", 6))


def corpus_stats_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics written to JSON by the first call and read back, not computed again, by the second."""
    path = scratch_path(spark, "stats")
    rows = inputs.fenced(spark, folder).select(extract_code(F.col("output")).alias("code"))
    for _ in range(2):
        stats = tables.stored_stats(spark, path, lambda: corpus.corpus_stats(rows))
    return stats.withColumn("average_code_length", F.round("average_code_length", 6))


def corpus_table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The raw corpus written as a table by language, and read without its prompt columns."""
    raw = inputs.fenced(spark, folder, "lang").withColumns({"instruction": F.lit("i"), "system": F.lit("s")})
    path = scratch_path(spark, "corpus")
    tables.write_table(raw, path, ["lang"])
    return tables.read_corpus(spark, path).select("doc_id", F.col("lang").cast("string").alias("lang"), "output")


def attrition(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.attrition(inputs.fenced(spark, folder), "output")


def _positioned(spark: SparkSession, folder: str) -> DataFrame:
    return positions.with_position(tables.scan(spark, folder, "documents").select("doc_id"), "doc_id")


def _total(spark: SparkSession, folder: str):
    return positions.row_total(tables.scan(spark, folder, "documents"))


def dense_position(spark: SparkSession, folder: str) -> DataFrame:
    return _positioned(spark, folder).withColumn("index", F.col("pos") + 1)


def slice_overflow(spark: SparkSession, folder: str) -> DataFrame:
    """Two slices of half the table: one fits, one runs over the end and restarts at 0."""
    rows = _positioned(spark, folder)
    total = _total(spark, folder)
    half = F.floor(total / 2)
    fits = positions.slice_rows(rows, F.floor(total / 4), half, total).withColumn("slice", F.lit("fits"))
    over = positions.slice_rows(rows, F.floor(total * 3 / 4), half, total).withColumn("slice", F.lit("over"))
    return fits.unionByName(over)


def stage1_rows(spark: SparkSession, folder: str) -> DataFrame:
    total = _total(spark, folder)
    return positions.stage1_rows(_positioned(spark, folder), F.floor(total / 3))


def stage2_rows(spark: SparkSession, folder: str) -> DataFrame:
    total = _total(spark, folder)
    third = F.floor(total / 3)
    return positions.stage2_rows(_positioned(spark, folder), F.lit(0), third, third)


POSITIONS = "ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"

# Untidy report cells made of every document, one per way a cell can be untidy.
CELL_SQL = """CASE n_chars % 8 WHEN 0 THEN NULL WHEN 1 THEN '0,' || n_chars || chr(10)
  WHEN 2 THEN n_chars || '.5.7,' WHEN 3 THEN '  ' || n_chars || ' ' WHEN 4 THEN 'about ' || n_chars || '.25 %'
  WHEN 5 THEN lang WHEN 6 THEN '-' || n_chars || 'e-2' ELSE n_chars || ',,' || doc_id END"""
CELL_SPARK = CELL_SQL.replace("chr(10)", "'\\n'")


def clean_numeric(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.scan(spark, folder, "documents").selectExpr("doc_id", f"{CELL_SPARK} AS cell")
    return rows.select("doc_id", F.round(clean_number(F.col("cell")), 6).alias("value"))


_CELL_FLAT = "trim(replace(replace(cell, chr(10), ''), ',', '.'))"
_CELL_TEXT = f"""CASE WHEN contains({_CELL_FLAT}, '.') THEN split_part({_CELL_FLAT}, '.', 1) || '.' ||
  replace(substr({_CELL_FLAT}, strpos({_CELL_FLAT}, '.') + 1), '.', '') ELSE {_CELL_FLAT} END"""


def display_names(spark: SparkSession, folder: str) -> DataFrame:
    name = "concat(' ', lang, ' (', source, ') (', n_chars, ') ')"
    rows = tables.scan(spark, folder, "documents").selectExpr("doc_id", f"{name} AS name")
    return rows.select("doc_id", display_name(F.col("name")).alias("display_name"))


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    tables.write_csv(tables.scan(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    return tables.read_csv(spark, path, "doc_id long, text string, lang string")


NAME_SQL = """CASE doc_id % 7
  WHEN 0 THEN 'partial_translation_en_' || lang || '_0_30_10.csv'
  WHEN 1 THEN 'Stage_1_google_en_' || lang || '_' || doc_id || '_30_10.csv'
  WHEN 2 THEN 'Stage_2_' || source || '_en_zh-CN_' || doc_id || '_30_10_5.csv'
  WHEN 3 THEN 'partial_back_translation_' || source || '_en_' || lang || '_' || doc_id || '_15.csv'
  WHEN 4 THEN 'partial_back_translation_google_en_' || lang || '_' || doc_id || '.csv'
  WHEN 5 THEN 'evaluation_summary_' || source || '_en_' || lang || '_' || doc_id || '.json'
  ELSE 'notes_' || doc_id || '.txt' END"""


def run_key_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.scan(spark, folder, "documents").selectExpr("doc_id", f"{NAME_SQL} AS file_name")
    return rows.select("doc_id", *run_key(F.col("file_name")))


QUERIES = {
    "extract_fenced": (extract_fenced, f"WITH {BLOCKS} SELECT doc_id, code FROM blocks"),
    "keyword_filter": (
        keyword_filter,
        f"WITH {BLOCKS} SELECT doc_id, {KEYWORD_SQL} AS is_code FROM blocks WHERE code IS NOT NULL",
    ),
    "dedup_snippets": (
        dedup_snippets,
        f"WITH {SNIPPETS} SELECT doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS r"
        " FROM snippets) WHERE r = 1",
    ),
    "corpus_stats": (
        corpus_stats,
        f"""WITH {BLOCKS}, codes AS (SELECT CASE WHEN {KEYWORD_SQL} THEN code END AS code FROM blocks)
SELECT count(*) AS total_samples, count(DISTINCT code) AS unique_samples,
  round(avg(length(code)), 6) AS average_code_length, min(length(code)) AS min_code_length,
  max(length(code)) AS max_code_length, count(*) - count(code) AS null_values FROM codes""",
    ),
    "corpus_stats_roundtrip": (
        corpus_stats_roundtrip,
        f"""WITH {BLOCKS}, codes AS (SELECT CASE WHEN {KEYWORD_SQL} THEN code END AS code FROM blocks)
SELECT CAST(count(*) AS DOUBLE) AS total_samples, CAST(count(DISTINCT code) AS DOUBLE) AS unique_samples,
  round(avg(length(code)), 6) AS average_code_length, CAST(min(length(code)) AS DOUBLE) AS min_code_length,
  CAST(max(length(code)) AS DOUBLE) AS max_code_length, CAST(count(*) - count(code) AS DOUBLE) AS null_values FROM codes""",
    ),
    "corpus_table_roundtrip": (
        corpus_table_roundtrip,
        f"WITH {inputs.FENCED} SELECT doc_id, lang, output FROM fenced JOIN documents USING (doc_id)",
    ),
    "attrition": (
        attrition,
        f"""WITH {SNIPPETS} SELECT i AS initial_size, f AS final_size, i - f AS removed
FROM (SELECT count(*) AS i FROM documents), (SELECT count(DISTINCT code) AS f FROM snippets)""",
    ),
    "dense_position": (dense_position, f"WITH {POSITIONS} SELECT doc_id, pos, pos + 1 AS index FROM ranked"),
    "slice_overflow": (
        slice_overflow,
        f"""WITH {POSITIONS}
SELECT doc_id, pos, 'fits' AS slice FROM ranked WHERE pos >= n // 4 AND pos < n // 4 + n // 2
UNION ALL SELECT doc_id, pos, 'over' FROM ranked WHERE pos < n // 2""",
    ),
    "stage1_rows": (stage1_rows, f"WITH {POSITIONS} SELECT doc_id, pos FROM ranked WHERE pos < n // 3"),
    "stage2_rows": (
        stage2_rows,
        f"WITH {POSITIONS} SELECT doc_id, pos FROM ranked WHERE pos >= n // 3 AND pos < n // 3 + n // 3",
    ),
    "clean_numeric": (
        clean_numeric,
        rf"""WITH cells AS (SELECT doc_id, {CELL_SQL} AS cell FROM documents),
texts AS (SELECT doc_id, {_CELL_TEXT} AS t FROM cells)
SELECT doc_id, round(coalesce(try_cast(t AS DOUBLE),
  try_cast(nullif(regexp_extract(t, '(\d+\.?\d*)', 1), '') AS DOUBLE), 0.0), 6) AS value FROM texts""",
    ),
    "display_name": (display_names, "SELECT doc_id, lang AS display_name FROM documents"),
    "csv_roundtrip": (csv_roundtrip, "SELECT doc_id, text, lang FROM documents"),
    "run_key_parse": (
        run_key_parse,
        """SELECT doc_id,
  CASE doc_id % 7 WHEN 0 THEN 'partial_translation' WHEN 1 THEN 'Stage_1' WHEN 2 THEN 'Stage_2'
    WHEN 5 THEN 'evaluation_summary' WHEN 6 THEN NULL ELSE 'partial_back_translation' END AS kind,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'google' WHEN 4 THEN 'google' WHEN 6 THEN NULL ELSE source END AS model,
  CASE WHEN doc_id % 7 < 6 THEN 'en' END AS source_lang,
  CASE doc_id % 7 WHEN 2 THEN 'zh-CN' WHEN 6 THEN NULL ELSE lang END AS target_lang,
  CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN doc_id WHEN 2 THEN doc_id END AS start_index,
  CASE doc_id % 7 WHEN 0 THEN 30 WHEN 1 THEN 30 WHEN 2 THEN 30 WHEN 4 THEN doc_id END AS stage1_samples,
  CASE doc_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN doc_id END AS stage2_samples,
  CASE doc_id % 7 WHEN 2 THEN 5 WHEN 3 THEN 15 WHEN 5 THEN doc_id END AS chunk_size
FROM documents""",
    ),
}
