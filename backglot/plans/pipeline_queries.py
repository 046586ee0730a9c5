"""Registered queries: slices of a stored table, held-out stage 2, and the staged round trip with its resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.languages import language_name
from backglot.operators import fewshot as fs
from backglot.operators import reports
from backglot.operators.positions import store_positions, stored_slice
from backglot.operators.stages import StagedRun
from backglot.operators.substitution import substitute_documents
from backglot.plans import inputs, roundtrip
from backglot.plans import sqltext as q
from backglot.plans.fewshot_queries import MODELS, cleaned_sql, request_sql
from backglot.plans.inputs import SOURCE, TARGET
from backglot.plans.metric_queries import (
    PROFILE_COLUMNS,
    STRUCTURE,
    SUMMARY,
    SUMMARY_SQL,
    TOKEN_MATCH,
    rounded,
)
from backglot.plans.roundtrip import CELL, RUN, TRANSLATOR, RoundTrip
from backglot.plans.token_queries import translated_sql
from backglot.session import scratch_path
from backglot.sources.tables import hand_over, scan

RANGE = 64  # rows of one stored range: the test tables have several


def partial_forward_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Partial translation of two slices: one inside the table, one that runs over its end and starts at 0."""
    path = scratch_path(spark, "positions")
    store_positions(inputs.documents(spark, folder), "doc_id", path, RANGE)
    total = scan(spark, folder, "documents").count()
    words = inputs.words_for(spark, folder)

    def one(start: int, size: int) -> DataFrame:
        rows = stored_slice(spark, path, start, size).withColumn("start_index", F.lit(start).cast("long"))
        done = substitute_documents(rows, "doc_id", "text", "partial", words, inputs.FORWARD)
        return done.select("start_index", "row", "doc_id", "partial")

    return one(total // 2, total // 4).union(one(total - 5, total // 8))


def digest_answers(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """A response for most requests: which conversation and turn follows from the request's digest alone."""
    number = lambda start: F.conv(F.substring("request_id", start, 8), 16, 10).cast("long")
    conversations = scan(spark, folder, "conversations").agg(F.count_distinct("conv_id")).scalar()
    asked = requests.where(F.col("request_id").isNotNull()).select("model", "request_id").distinct()
    asked = asked.select("model", "request_id", (number(1) % conversations).alias("conv_id"), (number(9) % 4).alias("turn"))
    given = inputs.responses(spark, folder).select("conv_id", "turn", "response")
    return hand_over(asked.join(given, ["conv_id", "turn"]).select("model", "request_id", "response"), "responses")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs, the second one over the end of the corpus; all models; few-shot sizes cut to the stage-1 rows."""
    total = scan(spark, folder, "documents").count()
    runs = [(start, total // 20, total // 10) for start in (total // 2, total - 5)]
    sized = fs.sweep_grid(spark.createDataFrame(runs, ", ".join(f"{c} long" for c in RUN)), "stage1_samples")
    return sized.withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))


def _round_trip(spark: SparkSession, folder: str) -> RoundTrip:
    return RoundTrip(
        spark,
        inputs.documents(spark, folder),
        inputs.words_for(spark, folder),
        inputs.memory(spark, folder),
        lambda requests: digest_answers(spark, folder, requests),
        range_rows=RANGE,
    )


def staged(spark: SparkSession, folder: str, path: str, grid: DataFrame | None = None) -> StagedRun:
    return StagedRun(spark, path, _grid(spark, folder) if grid is None else grid, _round_trip(spark, folder).stages(path))


def _summaries(run: StagedRun) -> DataFrame:
    return rounded(roundtrip.all_summaries(run.table("state1"), run.table("state2")), SUMMARY)


def stage2_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Stage 2 of every run, model and few-shot size over the run's held-out rows only."""
    run = staged(spark, folder, scratch_path(spark, "run"))
    run.run(until="stage2")
    rows = roundtrip.stage2_texts(run.table("stage2"), run.table("partial"))
    return rows.select(*CELL, "row", "doc_id", "partial", "translated", "status")


def pipeline_summary(spark: SparkSession, folder: str) -> DataFrame:
    run = staged(spark, folder, scratch_path(spark, "run"))
    run.run()
    return _summaries(run)


def pipeline_details(spark: SparkSession, folder: str) -> DataFrame:
    """Detail rows of both stages with their run key, few-shot size and 1-based index."""
    run = staged(spark, folder, scratch_path(spark, "run"))
    run.run()
    second = roundtrip.details2_texts(run.table("details2"), run.table("partial"), run.table("back2"), run.table("own"))
    rows = roundtrip.all_details(run.table("details1"), second)
    return rounded(rows, ["bleu_score", "structure_score", "semantic_score", "token_match", "overall_score"])


def pipeline_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The same summary from three starts: one model up to stage 2, then all up to the way back, then all stages."""
    path = scratch_path(spark, "run")
    grid = hand_over(_grid(spark, folder), "grid")
    staged(spark, folder, path, grid.where(F.col("model") == MODELS[0])).run(until="stage2")
    staged(spark, folder, path, grid).run(until="back2")
    run = staged(spark, folder, path, grid)
    run.run()
    return _summaries(run)


def merged_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means per language from the stored states of two batches of scores, merged without reading the scores again."""
    names = {"overall": "overall_score"}
    scores = inputs.scores(spark, folder).withColumnsRenamed(names).withColumn("syntax_valid", F.col("syntax_valid_rate") / 100)
    batches = [scores.where("pos % 3 = 0"), scores.where("pos % 3 <> 0")]
    states = [hand_over(reports.summary_state(batch, ["model", "language"]), "state") for batch in batches]
    merged = reports.merge_states(states[0].unionByName(states[1]), ["model", "language"])
    return rounded(reports.finish_summary(merged, ["model", "language"]), SUMMARY)


ENGLISH, SPANISH = language_name(SOURCE), language_name(TARGET)
SLICED = f"""total AS (SELECT count(*) AS n FROM documents),
placed AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id AS real_id, text FROM documents)"""
PIPELINE = f"""{inputs.DICT}, {inputs.MEMORY}, {inputs.BACK_MEMORY}, {inputs.RESPONSES}, {SLICED},
runs AS (SELECT unnest([n // 2, n - 5]) AS start_index, n // 20 AS stage1_samples, n // 10 AS stage2_samples, n FROM total),
begun AS (SELECT *, CASE WHEN start_index + stage1_samples + stage2_samples > n THEN 0 ELSE start_index END AS b FROM runs),
p_rows AS (SELECT start_index * 1000000 + pos - b AS doc_id, start_index, stage1_samples, stage2_samples, pos - b AS row, real_id, text
  FROM begun JOIN placed ON pos >= b AND pos < b + stage1_samples + stage2_samples),
{q.substituted("p", "p_rows", "text", SOURCE, TARGET)},
partials AS (SELECT p_rows.*, out AS partial FROM p_rows JOIN p_doc USING (doc_id)),
firsts AS (SELECT * FROM partials WHERE row < stage1_samples),
{q.parts("d", "firsts", "doc_id", "partial")}, {translated_sql("d", SOURCE, TARGET, "memory")},
{q.substituted("e", "d_doc", "out", TARGET, SOURCE)},
{q.parts("g", "e_doc", "doc_id", "out")}, {translated_sql("g", TARGET, SOURCE, "back_memory")},
sweep AS (SELECT unnest([0, 5, 10, 15, 25]) AS k),
sizes AS (SELECT DISTINCT start_index, CAST(least(k, stage1_samples) AS BIGINT) AS chunk_size FROM runs, sweep),
examples AS (SELECT start_index, row AS pos, text AS src, out AS tgt FROM firsts JOIN d_doc USING (doc_id)),
{{sets}},
asked AS (SELECT p.* EXCLUDE (doc_id), chunk_size, model,
    p.doc_id * 1000 + chunk_size * 2 + CAST(model = 'second' AS INT) AS doc_id
  FROM partials p JOIN sizes USING (start_index), (VALUES ('first'), ('second')) AS m(model) WHERE row >= stage1_samples),
{{forward}},
b_rows AS (SELECT doc_id, translated FROM f2_done),
{q.substituted("b", "b_rows", "translated", TARGET, SOURCE)},
back_asked AS (SELECT a.* EXCLUDE (partial), out AS partial_back FROM asked a JOIN b_doc USING (doc_id)),
{{backward}},
pairs AS (
  SELECT 1 AS stage, start_index, stage1_samples, stage2_samples, '{TRANSLATOR}' AS model, CAST(0 AS BIGINT) AS chunk_size,
    row + 1 AS index, text AS original, e_doc.out AS partial_back, g_doc.out AS back, doc_id * 1000 + 999 AS doc_id
  FROM firsts JOIN e_doc USING (doc_id) JOIN g_doc USING (doc_id)
  UNION ALL SELECT 2, start_index, stage1_samples, stage2_samples, model, chunk_size, row - stage1_samples + 1, text,
    partial_back, translated, doc_id FROM b2_done),
profiles AS (SELECT *, {PROFILE_COLUMNS} FROM pairs),
{{counted}},
scored AS (SELECT c.*, b.valid AS syntax_valid, bleu_score, {STRUCTURE} AS structure_score, 0.0 AS semantic_score,
  {TOKEN_MATCH} AS token_match FROM counted c JOIN m_bleu USING (doc_id)),
details AS (SELECT *, (bleu_score + CAST(syntax_valid AS INT) + structure_score + semantic_score + token_match) / 5 AS overall_score
  FROM scored)"""


def _sets_sql(name: str, src: str, tgt: str) -> str:
    return f"""{name} AS (
  SELECT s.start_index, chunk_size, coalesce(string_agg(chr(10) || 'Example ' || (pos + 1) || ':' || chr(10) || 'Original code:'
      || chr(10) || {src} || chr(10) || 'Complete translation:' || chr(10) || {tgt} || chr(10) || {q.text(fs.EXAMPLE_RULE)}
      || chr(10), '' ORDER BY pos), '') AS examples_text
  FROM sizes s LEFT JOIN examples e ON e.start_index = s.start_index AND pos < chunk_size GROUP BY s.start_index, chunk_size)"""


def _done_sql(name: str, rows: str, code: str, source: str, target: str, sets: str) -> str:
    """Twin of a completion with :func:`digest_answers`."""
    number = "CAST(CAST('0x' || substr(request_id, {}, 8) AS UBIGINT) AS BIGINT)"
    return f"""{name}_asked AS (SELECT r.*, {request_sql("r." + code, "r.model", source, target)} AS request_id
  FROM {rows} r JOIN {sets} USING (start_index, chunk_size)),
{name}_done AS (SELECT a.*, response, coalesce({cleaned_sql(True)}, {code}) AS translated FROM {name}_asked a LEFT JOIN responses r
  ON r.conv_id = {number.format(1)} % (SELECT count(DISTINCT conv_id) FROM conversations) AND r.turn = {number.format(9)} % 4)"""


def _pipeline_sql() -> str:
    from backglot.plans.metric_queries import KINDS

    return (
        PIPELINE.replace("{sets}", f"{_sets_sql('sets', 'src', 'tgt')}, {_sets_sql('back_sets', 'tgt', 'src')}")
        .replace("{forward}", _done_sql("f2", "asked", "partial", ENGLISH, SPANISH, "sets"))
        .replace("{backward}", _done_sql("b2", "back_asked", "partial_back", SPANISH, ENGLISH, "back_sets"))
        .replace("{counted}", f"counted AS (SELECT *, a.tokens AS ref, b.tokens AS cand, {KINDS} FROM profiles), {q.bleu('m', 'counted', 'doc_id', 'ref', 'cand')}")
    )


SUMMARY_TWIN = f"""WITH {_pipeline_sql()} SELECT stage, {", ".join(CELL)}, count(*) AS total_translations, {SUMMARY_SQL}
FROM details GROUP BY ALL"""
DETAIL_SCORES = ["bleu_score", "structure_score", "semantic_score", "token_match", "overall_score"]

QUERIES = {
    "partial_forward_slice": (
        partial_forward_slice,
        f"""WITH {inputs.DICT}, {SLICED},
slices AS (SELECT n // 2 AS start_index, n // 2 AS b, n // 4 AS size FROM total UNION ALL SELECT n - 5, 0, n // 8 FROM total),
rows AS (SELECT start_index * 1000000 + pos - b AS doc_id, start_index, pos - b AS row, real_id, text
  FROM slices JOIN placed ON pos >= b AND pos < b + size),
{q.substituted("s", "rows", "text", SOURCE, TARGET)}
SELECT start_index, row, real_id AS doc_id, out AS partial FROM rows JOIN s_doc USING (doc_id)""",
    ),
    "stage2_holdout": (
        stage2_holdout,
        f"""WITH {_pipeline_sql()} SELECT {", ".join(CELL)}, row, real_id AS doc_id, partial, translated,
  CASE WHEN response IS NULL THEN 'missing' ELSE 'answered' END AS status FROM f2_done""",
    ),
    "pipeline_summary": (pipeline_summary, SUMMARY_TWIN),
    "pipeline_resume": (pipeline_resume, SUMMARY_TWIN),
    "pipeline_details": (
        pipeline_details,
        f"""WITH {_pipeline_sql()} SELECT stage, {", ".join(CELL)}, index, original, partial_back, back, syntax_valid,
  {", ".join(f"round({c}, 6) AS {c}" for c in DETAIL_SCORES)} FROM details""",
    ),
    "merged_summary": (
        merged_summary,
        f"""WITH {inputs.SCORES} SELECT model, language, count(*) AS total_translations,
  {", ".join(f"round(avg({'overall' if c == 'overall_score' else c}), 6) AS {c}" for c in SUMMARY)} FROM scores GROUP BY ALL""",
    ),
}
