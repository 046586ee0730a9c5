"""Stage 2: sweep grid, few-shot prompts, request manifest, answers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backglot.functions.text import clean_response
from backglot.operators.lookup import fits_broadcast, lookup_join
from backglot.sources.tables import hand_over

CHUNK_SIZES = [0, 5, 10, 15, 25]  # fixed values: few-shot sizes of the sweep
MOST_SIZES = 1_000  # distinct sizes of one sweep

# Prompt texts.
EXAMPLE_RULE = "-" * 50
PROMPT_TEMPLATE = """Complete the translation of this partially {source} Python code to completely {target} python code:
            - Translate variable names, function names, strings and comments to {target}
            - Join multi-word {target} translations with underscores
            - Break down compound {source} words separated by underscores and translate each part into sensible {target} and join them back with underscores
            - Preserve code structure and syntax
            - Here are some examples of translations:

            Examples:
            {examples}

            Code to translate:
            {code}

            Return only the complete translated code."""
SYSTEM_TEMPLATE = (
    "You are a Expert Python code translator who understands the nuanses of language in coding and converts code "
    "from {source} to  {target} code while preserving functionality. Return only the translated code without any "
    "explanation."
)


def chunk_sizes(stage1_rows: Column) -> Column:
    """Sorted distinct few-shot sizes, each cut to the number of stage-1 rows."""
    sizes = F.array(*[F.lit(k).cast("long") for k in CHUNK_SIZES])
    return F.array_sort(F.array_distinct(F.transform(sizes, lambda k: F.least(k, stage1_rows.cast("long")))))


def sweep_grid(counts: DataFrame, stage1_rows: str) -> DataFrame:
    """One row per run and few-shot size."""
    return counts.withColumn("chunk_size", F.explode(chunk_sizes(F.col(stage1_rows))))


def example_text(number: Column, original: Column, translated: Column) -> Column:
    return F.concat(
        F.lit("\nExample "),
        number.cast("string"),
        F.lit(":\nOriginal code:\n"),
        original,
        F.lit("\nComplete translation:\n"),
        translated,
        F.lit(f"\n{EXAMPLE_RULE}\n"),
    )


def example_sets(examples: DataFrame, grid: DataFrame, reverse: bool = False, run: list[str] = ()) -> DataFrame:
    """``(run, chunk_size, n_examples, examples_text)``: the first ``chunk_size`` examples in order, of every run.

    ``examples`` needs ``pos, src, tgt``; only the prefix that the grid's largest size can use is read into the sets.
    ``reverse`` turns the examples round, for the way back. ``run`` names the columns of ``examples`` and ``grid`` that
    tell runs apart.
    """
    sizes = grid.select(*run, "chunk_size").distinct()
    known = sorted(r[0] for r in sizes.select("chunk_size").distinct().limit(MOST_SIZES + 1).collect())
    if len(known) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} few-shot sizes in one sweep")
    if reverse:
        examples = examples.select(*run, "pos", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    using = F.filter(F.array(*[F.lit(k).cast("long") for k in known]), lambda k: k > F.col("pos"))
    placed = examples.where(F.col("pos") < max(known, default=0))
    texts = (
        placed.select(*run, F.explode(using).alias("chunk_size"), "pos", "src", "tgt")
        .groupBy(*run, "chunk_size")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "src", "tgt"))).alias("chosen"))
        .select(
            *run,
            "chunk_size",
            F.size("chosen").cast("long").alias("n_examples"),
            F.array_join(
                F.transform("chosen", lambda e: example_text(e["pos"] + 1, e["src"], e["tgt"])), ""
            ).alias("examples_text"),
        )
    )
    return sizes.join(texts, [*run, "chunk_size"], "left").fillna({"n_examples": 0, "examples_text": ""})


def set_digests(sets: DataFrame) -> DataFrame:
    """Sets with the digest of their text instead of the text: hashed once per set, not once per prompt."""
    return sets.withColumn("set_digest", F.sha2("examples_text", 256)).drop("examples_text")


def with_sets(sized: DataFrame, sets: DataFrame, run: list[str] = ()) -> DataFrame:
    """Rows with ``chunk_size`` beside their example set; broadcast if the measured texts allow it."""
    sets = F.broadcast(sets) if fits_broadcast(sets) else sets
    absent = F.raise_error(F.concat(F.lit("no example set of size "), F.col("chunk_size").cast("string")))
    held = "examples_text" if "examples_text" in sets.columns else "set_digest"
    return sized.join(sets, [*run, "chunk_size"], "left").withColumn(held, F.coalesce(held, absent.cast("string")))


def request_digest(set_digest: Column, code_digest: Column, model: Column, source: str, target: str) -> Column:
    """Identity of a request: digest of the example set's digest, the code's digest, the model and the direction.

    Two requests are one exactly when their set, code, model and direction are; no prompt is built for it. A null code
    has a null digest and no request.
    """
    return F.sha2(F.concat(set_digest, F.lit(" "), code_digest, F.lit(" "), model, F.lit(f" {source}>{target}")), 256)


def prompt_text(examples: Column, code: Column, source: str, target: str) -> Column:
    """The prompt around an example text and a code text."""
    head, rest = PROMPT_TEMPLATE.split("{examples}")
    middle, tail = rest.split("{code}")
    fill = {"source": source, "target": target}
    return F.concat(
        F.lit(head.format(**fill)), examples, F.lit(middle.format(**fill)), code, F.lit(tail.format(**fill))
    )


def system_text(source: str, target: str) -> str:
    return SYSTEM_TEMPLATE.format(source=source, target=target)


def build_prompts(
    rows: DataFrame, code: str, sizes: Column, sets: DataFrame, source: str, target: str
) -> DataFrame:
    """Every row once per few-shot size, with its ``prompt``.

    ``sizes`` is the array of the run's few-shot sizes. A size without a set is an error.
    """
    sized = rows.withColumn("chunk_size", F.explode(sizes))
    prompt = prompt_text(F.col("examples_text"), F.col(code), source, target)
    return with_sets(sized, sets).withColumn("prompt", prompt).drop("examples_text")


def with_requests(sized: DataFrame, sets: DataFrame, source: str, target: str, run: list[str] = ()) -> DataFrame:
    """``sized`` rows with ``chunk_size``, ``model`` and ``code_digest``, with their ``request_id``."""
    placed = with_sets(sized, set_digests(sets), run)
    digest = request_digest(F.col("set_digest"), F.col("code_digest"), F.col("model"), source, target)
    return placed.withColumn("request_id", digest).drop("set_digest", "n_examples", "code_digest")


def request_manifest(prompts: DataFrame, key: str) -> DataFrame:
    """Distinct requests with their number of callers.

    Only digests and keys are aggregated: the prompt is built from the first caller's row when the request is sent.
    """
    return prompts.groupBy("model", "chunk_size", "request_id").agg(
        F.count(F.lit(1)).alias("callers"), F.min(key).alias("first_caller")
    )


def with_responses(callers: DataFrame, responses: DataFrame, keys: list[str], row_id: list[str]) -> DataFrame:
    """Callers with their ``response``, or null.

    ``keys`` name the model and the request, so models that are asked the same do not mix. Of several responses to
    one request the least counts; a caller with a null key has no answer.
    """
    whole = F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
    answers = responses.select(whole.alias("_key"), "response").where(F.col("_key").isNotNull())
    answers = hand_over(answers.groupBy("_key").agg(F.min("response").alias("response")), "answers")
    return lookup_join(callers.withColumn("_key", whole), answers, "_key", row_id).select(*callers.columns, "response")


def complete(answered: DataFrame, code: str | None, bare_fences: bool) -> DataFrame:
    """``translated`` and ``status`` from the ``response``; a caller without an answer keeps its code.

    Where the code is stored elsewhere (``code`` is None), such a caller has no ``translated``: its reader takes the code.
    """
    cleaned = clean_response(F.col("response"), bare_fences)
    return answered.select(
        *[c for c in answered.columns if c != "response"],
        (cleaned if code is None else F.coalesce(cleaned, F.col(code))).alias("translated"),
        F.when(F.col("response").isNull(), "missing").otherwise("answered").alias("status"),
    )


def join_responses(
    callers: DataFrame, code: str, responses: DataFrame, keys: list[str], row_id: list[str], bare_fences: bool
) -> DataFrame:
    """Add ``translated`` and ``status`` to callers that hold their ``code``.

    Where several callers share a text, :func:`with_responses` takes callers without texts, and the text is joined after it.
    """
    return complete(with_responses(callers, responses, keys, row_id), code, bare_fences)
