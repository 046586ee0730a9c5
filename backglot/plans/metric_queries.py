"""Registered queries: pair metrics and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.profiles import (
    BEFORE_COMMA,
    CAPITALISED,
    CONNECTIVE,
    NAME,
    TEXT_TOKEN,
    text_profile,
    text_tokens,
)
from backglot.operators import metrics, reports
from backglot.plans import inputs
from backglot.plans import sqltext as q
from backglot.sources.tables import read_summaries, scan, write_json
from backglot.session import scratch_path


def metric_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = inputs.documents(spark, folder).select("doc_id", text_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def bleu4(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_counts(spark, folder).select("doc_id", F.round(metrics.bleu_score(), 6).alias("bleu_score"))


def _pair_counts(spark: SparkSession, folder: str, most: int = metrics.MAX_N) -> DataFrame:
    pairs = inputs.pairs(spark, folder)
    tokens = pairs.select("doc_id", text_tokens(F.col("original")).alias("ref"), text_tokens(F.col("back")).alias("cand"))
    return metrics.pair_counts(tokens, "doc_id", "ref", "cand", most)


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.pairs(spark, folder)
    return rows.select("doc_id", text_profile(F.col("original")).alias("a"), text_profile(F.col("back")).alias("b"))


def structure_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    score = F.round(metrics.structure_score("a", "b"), 6)
    return _profiles(spark, folder).select("doc_id", score.alias("structure_score"))


def token_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_counts(spark, folder, 1).select("doc_id", F.round(metrics.token_match(), 6).alias("token_match"))


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    vectors = scan(spark, folder, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    joined = vectors.select("vec_id", "embedding").join(following, "vec_id")
    return joined.select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


def _details(spark: SparkSession, folder: str) -> DataFrame:
    """Text variant: the vectors of a document and of its successor stand in for both texts."""
    vectors = scan(spark, folder, "embeddings")
    docs = (
        inputs.documents(spark, folder, "lang", "source")
        .join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("ea")), "doc_id", "left")
        .join(vectors.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("eb")), "doc_id", "left")
    )
    pairs = inputs.pairs_of(docs, inputs.words_for(spark, folder))
    return metrics.evaluate_pairs(pairs, text_profile, ("ea", "eb"))


SCORES = ["bleu_score", "structure_score", "semantic_score", "token_match", "overall_score"]


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def evaluation_details(spark: SparkSession, folder: str) -> DataFrame:
    rows = _details(spark, folder).select("doc_id", "original", "translated", "back", "syntax_valid", *SCORES)
    return rounded(rows, SCORES)


def overall_score(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_details(spark, folder).select("doc_id", "overall_score"), ["overall_score"])


SUMMARY = ["bleu_score", "syntax_valid_rate", "structure_score", "semantic_score", "token_match", "overall_score"]


def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.evaluation_summary(_details(spark, folder), ["lang", "source"]), SUMMARY)


def summary_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of every language and few-shot size written to one JSON folder and read back."""
    details = _details(spark, folder).withColumn("chunk_size", F.col("doc_id") % 5 * 5)
    summary = reports.evaluation_summary(details, ["lang", "chunk_size"]).drop("lang")
    path = scratch_path(spark, "summaries")
    write_json(summary, path)
    return rounded(read_summaries(spark, path).select("chunk_size", "total_translations", *SUMMARY), SUMMARY)


def validity_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of texts that are valid by the native profile, per language."""
    rate = F.avg(text_profile(F.col("text"))["valid"].cast("int")) * 100
    rows = inputs.documents(spark, folder, "lang")
    return rows.groupBy("lang").agg(F.count("text").alias("texts"), F.round(rate, 6).alias("syntax_valid_rate"))


# SQL twins.
TOKEN = q.text(TEXT_TOKEN)


def _profile_sql(column: str) -> str:
    def found(pattern: str, group: int = 0) -> str:
        return f"list_distinct(regexp_extract_all({column}, {q.text(pattern)}, {group}))"

    def occurrences(symbol: str) -> str:
        return f"(length({column}) - length(replace({column}, '{symbol}', '')))"

    return f"""{{'valid': {occurrences("(")} = {occurrences(")")} AND {occurrences('"')} % 2 = 0,
    'functions': {found(BEFORE_COMMA, 1)}, 'classes': {found(CAPITALISED)}, 'controls': {found(CONNECTIVE)},
    'tokens': regexp_extract_all({column}, {TOKEN})}}"""


def _jaccard_sql(name: str) -> str:
    return (
        f"CASE WHEN len(list_distinct(list_concat(a.{name}, b.{name}))) > 0 THEN "
        f"len(list_intersect(a.{name}, b.{name})) / len(list_distinct(list_concat(a.{name}, b.{name}))) END"
    )


def _mean_sql(values: list[str]) -> str:
    return f"coalesce(list_avg(list_filter([{', '.join(values)}], lambda v: v IS NOT NULL)), 0.0)"


STRUCTURE = _mean_sql([_jaccard_sql(n) for n in ("functions", "classes", "controls")])


def _count_sql(side: str, pattern: str) -> str:
    return f"len(list_filter({side}.tokens, lambda t: regexp_matches(t, {q.text(pattern)})))"


KIND_PATTERNS = {"names": f"^{NAME}", "strings": "^[\"'].*[\"']$", "numbers": "^[0-9]"}
KINDS = ", ".join(f"{_count_sql(s, p)} AS {k}_{s}" for k, p in KIND_PATTERNS.items() for s in "ab")
_RATIOS = [
    f"CASE WHEN greatest({a}, {b}) > 0 THEN least({a}, {b}) / greatest({a}, {b}) END"
    for a, b in [(f"{k}_a", f"{k}_b") for k in KIND_PATTERNS]
    + [tuple(f"(len({s}.tokens) - names_{s} - strings_{s} - numbers_{s})" for s in "ab")]
]
TOKEN_MATCH = f"""CASE WHEN len(a.tokens) = 0 AND len(b.tokens) = 0 THEN 1.0
  WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.0 ELSE {_mean_sql(_RATIOS)} END"""

PROFILE_COLUMNS = f"{_profile_sql('original')} AS a, {_profile_sql('back')} AS b"
PROFILES = f"""{inputs.pairs_sql()},
profiles AS (SELECT *, {PROFILE_COLUMNS} FROM pairs),
counted AS (SELECT *, a.tokens AS ref, b.tokens AS cand, {KINDS} FROM profiles)"""
COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
DETAILS = f"""{PROFILES}, {q.bleu("m", "counted", "doc_id", "ref", "cand")},
scored AS (
  SELECT c.doc_id, c.lang, c.source, original, translated, back, b.valid AS syntax_valid, bleu_score,
    {STRUCTURE} AS structure_score, coalesce({COSINE.format("e.embedding", "f.embedding")}, 0.0) AS semantic_score,
    {TOKEN_MATCH} AS token_match
  FROM counted c JOIN m_bleu USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = c.doc_id
  LEFT JOIN embeddings f ON f.vec_id = c.doc_id + 1),
details AS (
  SELECT *, (bleu_score + CAST(syntax_valid AS INT) + structure_score + semantic_score + token_match) / 5 AS overall_score FROM scored)"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)
SUMMARY_SQL = ", ".join(
    f"round(avg({c}), 6) AS {c}" if c != "syntax_valid_rate" else "round(avg(CAST(syntax_valid AS INT)) * 100, 6) AS syntax_valid_rate"
    for c in SUMMARY
)

QUERIES = {
    "metric_tokens": (
        metric_tokens,
        f"""SELECT doc_id, len(t) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens
FROM (SELECT doc_id, regexp_extract_all(text, {TOKEN}) AS t FROM documents)""",
    ),
    "bleu4": (
        bleu4,
        f"""WITH {inputs.pairs_sql()}, toks AS (SELECT doc_id, regexp_extract_all(original, {TOKEN}) AS ref,
  regexp_extract_all(back, {TOKEN}) AS cand FROM pairs), {q.bleu("m", "toks", "doc_id", "ref", "cand")}
SELECT doc_id, round(bleu_score, 6) AS bleu_score FROM m_bleu""",
    ),
    "structure_jaccard": (
        structure_jaccard,
        f"WITH {PROFILES} SELECT doc_id, round({STRUCTURE}, 6) AS structure_score FROM profiles",
    ),
    "token_mix": (token_mix, f"WITH {PROFILES} SELECT doc_id, round({TOKEN_MATCH}, 6) AS token_match FROM counted"),
    "cosine_pairs": (
        cosine_pairs,
        f"""SELECT e.vec_id, round({COSINE.format("e.embedding", "f.embedding")}, 6) AS similarity
FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1""",
    ),
    "overall_score": (
        overall_score,
        f"WITH {DETAILS} SELECT doc_id, round(overall_score, 6) AS overall_score FROM details",
    ),
    "evaluation_details": (
        evaluation_details,
        f"WITH {DETAILS} SELECT doc_id, original, translated, back, syntax_valid, {ROUNDED} FROM details",
    ),
    "evaluation_summary": (
        evaluation_summary,
        f"""WITH {DETAILS} SELECT lang, source, count(*) AS total_translations, {SUMMARY_SQL} FROM details GROUP BY lang, source""",
    ),
    "summary_json_roundtrip": (
        summary_json_roundtrip,
        f"""WITH {DETAILS} SELECT doc_id % 5 * 5 AS chunk_size, count(*) AS total_translations, {SUMMARY_SQL}
FROM details GROUP BY lang, doc_id % 5 * 5""",
    ),
    "validity_rate": (
        validity_rate,
        f"""WITH profiles AS (SELECT lang, {_profile_sql("text")} AS a FROM documents)
SELECT lang, count(*) AS texts, round(avg(CAST(a.valid AS INT)) * 100, 6) AS syntax_valid_rate FROM profiles GROUP BY lang""",
    ),
}
