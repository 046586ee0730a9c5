"""Registered queries: sweep grid, prompts, manifest, answers, stage 2 in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.languages import language_name
from backglot.functions.text import clean_response
from backglot.operators import fewshot as fs
from backglot.operators.substitution import substitute_documents
from backglot.plans import inputs
from backglot.plans import sqltext as q
from backglot.plans.inputs import SOURCE, TARGET
from backglot.sources.tables import hand_over, scan

ENGLISH, SPANISH = language_name(SOURCE), language_name(TARGET)
MODELS = ["first", "second"]  # both are asked the same prompts


def _sizes(spark: SparkSession, folder: str):
    """The run's few-shot sizes: those of the sweep, cut to the number of examples."""
    return fs.chunk_sizes(F.lit(scan(spark, folder, "benchmark").count()))


def _sets(spark: SparkSession, folder: str, reverse: bool = False) -> DataFrame:
    counts = scan(spark, folder, "benchmark").agg(F.count(F.lit(1)).alias("n1"))
    return fs.example_sets(inputs.examples(spark, folder), fs.sweep_grid(counts, "n1"), reverse)


def sweep_grid(spark: SparkSession, folder: str) -> DataFrame:
    runs = scan(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("stage1_samples"))
    return fs.sweep_grid(runs, "stage1_samples")


def example_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _sets(spark, folder)


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.documents(spark, folder, "source").withColumnRenamed("source", "model")
    return fs.build_prompts(rows, "text", _sizes(spark, folder), _sets(spark, folder), ENGLISH, SPANISH)


def build_prompts(spark: SparkSession, folder: str) -> DataFrame:
    system = F.lit(fs.system_text(ENGLISH, SPANISH)).alias("system")
    return _prompts(spark, folder).select("doc_id", "chunk_size", "n_examples", system, "prompt")


def request_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Requests told apart by the digest of their whole prompt."""
    requests = _prompts(spark, folder).withColumn("request_id", F.sha2("prompt", 256))
    return fs.request_manifest(requests.drop("prompt"), "doc_id")


def clean_response_any(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.responses(spark, folder)
    return rows.select("conv_id", "turn", clean_response(F.col("response"), True).alias("code"))


def clean_response_tagged(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.responses(spark, folder)
    return rows.select("conv_id", "turn", clean_response(F.col("response"), False).alias("code"))


def response_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """User turns are requests, the assistant's next turn is the answer."""

    def turn_key(turn):
        return F.concat_ws(":", "conv_id", turn)

    callers = (
        scan(spark, folder, "conversations")
        .where(F.col("role") == "user")
        .select("conv_id", "turn", "text", turn_key(F.col("turn") + 1).alias("request"))
    )
    answers = inputs.responses(spark, folder).where(F.col("role") == "assistant")
    answers = answers.select(turn_key(F.col("turn")).alias("request"), "response")
    joined = fs.join_responses(callers, "text", answers, ["request"], ["conv_id", "turn"], True)
    return joined.select("conv_id", "turn", "translated", "status")


def answers(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """Responses table, one answer per model and request: the first caller's conversation; each model has its own turns."""
    manifest = fs.request_manifest(requests, "doc_id")
    asked = manifest.select(
        "model",
        "request_id",
        F.col("first_caller").alias("conv_id"),
        (F.floor(F.col("chunk_size") / 5) + (F.col("model") == MODELS[1]).cast("long")).alias("turn"),
    )
    given = inputs.responses(spark, folder).select("conv_id", "turn", "response")
    return hand_over(asked.join(given, ["conv_id", "turn"]).select("model", "request_id", "response"), "responses")


def _stage2(spark: SparkSession, folder: str, texts: DataFrame, asked: DataFrame, code: str, source: str, target: str) -> DataFrame:
    """``asked`` has one row per text, few-shot size and model, and names its text by ``_row``.

    Requests and answers are found without the texts, which are joined once each. The way back turns the examples round.
    """
    requests = fs.with_requests(asked, _sets(spark, folder, source == SPANISH), source, target)
    given = answers(spark, folder, requests)
    found = fs.with_responses(requests, given, ["model", "request_id"], ["_row", "chunk_size", "model"])
    return fs.complete(found.drop("request_id").join(texts.select("_row", code), "_row"), code, True)


def _numbered(texts: DataFrame, code: str) -> DataFrame:
    """Texts with the digest of their code and an id of their own, stored."""
    hashed = texts.withColumn("code_digest", F.sha2(code, 256))
    return hand_over(hashed.withColumn("_row", F.monotonically_increasing_id()), "partial")


def _forward(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    words = inputs.words_for(spark, folder)
    partial = substitute_documents(docs, "doc_id", "text", "partial", words, inputs.FORWARD)
    texts = _numbered(partial.drop("text"), "partial")
    return _stage2(spark, folder, texts, _asked(texts, _sizes(spark, folder)), "partial", ENGLISH, SPANISH)


def _asked(texts: DataFrame, sizes) -> DataFrame:
    """Every text once per few-shot size and model."""
    sized = texts.select("_row", "doc_id", "code_digest").withColumn("chunk_size", F.explode(sizes))
    return sized.withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))


def stage2_forward(spark: SparkSession, folder: str) -> DataFrame:
    return _forward(spark, folder).select("doc_id", "chunk_size", "model", "translated", "status")


def stage2_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Stage-2 output of every model, substituted back and completed in the other direction by the same model.

    A document's equal outputs are substituted once.
    """
    callers = F.collect_list(F.struct("chunk_size", "model")).alias("callers")
    forward = _forward(spark, folder).groupBy("_row", "doc_id", "translated").agg(callers).drop("_row")
    words = inputs.words_for(spark, folder)
    partial = substitute_documents(forward, "doc_id", "translated", "partial_back", words, inputs.BACKWARD)
    texts = _numbered(partial.drop("translated"), "partial_back")
    asked = texts.select("_row", "doc_id", "code_digest", F.inline("callers"))
    done = _stage2(spark, folder, texts, asked, "partial_back", SPANISH, ENGLISH)
    return done.select("doc_id", "chunk_size", "model", "partial_back", F.col("translated").alias("back"), "status")


SWEEP = "sweep AS (SELECT unnest([0, 5, 10, 15, 25]) AS k)"
GRID = f"{SWEEP}, sizes AS (SELECT DISTINCT least(k, (SELECT count(*) FROM benchmark)) AS k FROM sweep)"


def sets_sql(name: str, src: str, tgt: str) -> str:
    return f"""{name} AS (
  SELECT CAST(k AS BIGINT) AS chunk_size, count(pos) AS n_examples,
    coalesce(string_agg(chr(10) || 'Example ' || (pos + 1) || ':' || chr(10) || 'Original code:' || chr(10) || {src} || chr(10)
      || 'Complete translation:' || chr(10) || {tgt} || chr(10) || {q.text(fs.EXAMPLE_RULE)} || chr(10), '' ORDER BY pos), '') AS examples_text
  FROM sizes LEFT JOIN examples ON pos < k GROUP BY k)"""


SETS = f"{inputs.EXAMPLES}, {GRID}, {sets_sql('sets', 'src', 'tgt')}, {sets_sql('back_sets', 'tgt', 'src')}"


def prompt_sql(code: str, source: str, target: str) -> str:
    filled = fs.PROMPT_TEMPLATE.format(source=source, target=target, examples="\0E\0", code="\0C\0")
    head, rest = filled.split("\0E\0")
    middle, tail = rest.split("\0C\0")
    return f"{q.text(head)} || examples_text || {q.text(middle)} || {code} || {q.text(tail)}"


def request_sql(code: str, model: str, source: str, target: str) -> str:
    """Twin of the composed request digest."""
    return f"sha256(sha256(examples_text) || ' ' || sha256({code}) || ' ' || {model} || ' {source}>{target}')"


def cleaned_sql(bare: bool) -> str:
    t = q.strip("response")
    tagged = q.strip(f"split_part(split_part({t}, '```python', 2), '```', 1)")
    plain = f"WHEN contains({t}, '```') THEN {q.strip(f'''split_part({t}, '```', 2)''')}" if bare else ""
    return f"CASE WHEN contains({t}, '```python') THEN {tagged} {plain} ELSE {t} END"


def stage2_sql(name: str, rows: str, code: str, source: str, target: str, sets: str = "sets") -> str:
    """``rows`` have a model column: the model that is asked."""
    return f"""{name}_prompts AS (
  SELECT r.*, {request_sql("r." + code, "r.model", source, target)} AS request_id FROM {rows} r JOIN {sets} USING (chunk_size)),
{name}_asked AS (SELECT model, request_id, min(doc_id) AS conv_id,
  min(chunk_size) // 5 + CAST(model = 'second' AS INT) AS turn FROM {name}_prompts GROUP BY model, request_id),
{name}_done AS (
  SELECT p.*, coalesce({cleaned_sql(True)}, {code}) AS translated,
    CASE WHEN response IS NULL THEN 'missing' ELSE 'answered' END AS status
  FROM {name}_prompts p LEFT JOIN ({name}_asked JOIN responses USING (conv_id, turn)) a USING (model, request_id))"""


FORWARD2 = f"""{inputs.DICT}, {q.substituted("f", "documents", "text", SOURCE, TARGET)}, {SETS}, {inputs.RESPONSES},
f_rows AS (SELECT doc_id, CAST(k AS BIGINT) AS chunk_size, model, out AS partial
  FROM f_doc, sizes, (VALUES ('first'), ('second')) AS m(model)),
{stage2_sql("f2", "f_rows", "partial", ENGLISH, SPANISH)}"""
BACKWARD2 = f"""{FORWARD2}, f2_rows AS (
  SELECT doc_id * 1000000 + chunk_size * 2 + CAST(model = 'second' AS INT) AS doc_id, translated FROM f2_done),
{q.substituted("b", "f2_rows", "translated", TARGET, SOURCE)},
b_rows AS (SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 // 2 AS chunk_size,
  CASE doc_id % 2 WHEN 1 THEN 'second' ELSE 'first' END AS model, out AS partial_back FROM b_doc),
{stage2_sql("b2", "b_rows", "partial_back", SPANISH, ENGLISH, "back_sets")}"""

QUERIES = {
    "sweep_grid": (
        sweep_grid,
        f"""WITH {SWEEP}, runs AS (SELECT source, lang, count(*) AS stage1_samples FROM documents GROUP BY ALL)
SELECT DISTINCT source, lang, stage1_samples, least(k, stage1_samples) AS chunk_size FROM runs, sweep""",
    ),
    "example_sets": (example_sets, f"WITH {SETS} SELECT chunk_size, n_examples, examples_text FROM sets"),
    "build_prompts": (
        build_prompts,
        f"""WITH {SETS} SELECT doc_id, chunk_size, n_examples, {q.text(fs.system_text(ENGLISH, SPANISH))} AS system,
  {prompt_sql("text", ENGLISH, SPANISH)} AS prompt FROM documents, sets""",
    ),
    "request_manifest": (
        request_manifest,
        f"""WITH {SETS}, prompts AS (
  SELECT source AS model, doc_id, chunk_size, sha256({prompt_sql("text", ENGLISH, SPANISH)}) AS request_id FROM documents, sets)
SELECT model, chunk_size, request_id, count(*) AS callers, min(doc_id) AS first_caller FROM prompts GROUP BY ALL""",
    ),
    "clean_response_any": (
        clean_response_any,
        f"WITH {inputs.RESPONSES} SELECT conv_id, turn, {cleaned_sql(True)} AS code FROM responses",
    ),
    "clean_response_tagged": (
        clean_response_tagged,
        f"WITH {inputs.RESPONSES} SELECT conv_id, turn, {cleaned_sql(False)} AS code FROM responses",
    ),
    "response_fallback": (
        response_fallback,
        f"""WITH {inputs.RESPONSES}, answers AS (
  SELECT conv_id, turn - 1 AS turn, response FROM responses JOIN conversations USING (conv_id, turn) WHERE role = 'assistant')
SELECT conv_id, turn, coalesce({cleaned_sql(True)}, text) AS translated,
  CASE WHEN response IS NULL THEN 'missing' ELSE 'answered' END AS status
FROM conversations LEFT JOIN answers USING (conv_id, turn) WHERE role = 'user'""",
    ),
    "stage2_forward": (stage2_forward, f"WITH {FORWARD2} SELECT doc_id, chunk_size, model, translated, status FROM f2_done"),
    "stage2_backward": (
        stage2_backward,
        f"WITH {BACKWARD2} SELECT doc_id, chunk_size, model, partial_back, translated AS back, status FROM b2_done",
    ),
}
