"""Inputs that queries derive from the test tables, each with its SQL twin.

The test tables hold prose. Code fences, keyword tables, translation memories, answers
and report sheets are derived from whole tables, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.lexing import Lexer, stage0_lexer, stage1_lexer
from backglot.operators.dictionary import keyword_dictionary
from backglot.operators.reports import REPORT_HEADERS
from backglot.operators.substitution import Lookup, inline_lookup, substitute_documents, usable_entries
from backglot.session import spread
from backglot.sources.tables import scan

SOURCE, TARGET = "en", "es"
FORWARD: Lexer = stage0_lexer(SOURCE, TARGET)
BACKWARD: Lexer = stage0_lexer(TARGET, SOURCE)
STAGE1_FORWARD: Lexer = stage1_lexer(SOURCE, TARGET)
STAGE1_BACKWARD: Lexer = stage1_lexer(TARGET, SOURCE)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(scan(spark, folder, "documents").select("doc_id", "text", *columns), "doc_id")


# Fenced corpus: English texts in a python fence, French ones in a bare fence, the rest plain.
FENCED = """fenced AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'x ```python' || chr(10) || text || chr(10) || '``` y'
                           WHEN 'fr' THEN '```' || chr(10) || text || '```' ELSE text END AS output
  FROM documents)"""


def fenced(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    text, lang = F.col("text"), F.col("lang")
    output = (
        F.when(lang == "en", F.concat(F.lit("x ```python\n"), text, F.lit("\n``` y")))
        .when(lang == "fr", F.concat(F.lit("```\n"), text, F.lit("```")))
        .otherwise(text)
    )
    return documents(spark, folder, "lang").select("doc_id", *columns, output.alias("output"))


# Keyword rows: every word occurrence of the benchmark, mapped many to one.
DICT = """dict_words AS (
  SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)),
dict_rows AS (SELECT item_id, p, word AS src, word[1] || word[-1:] || 'o' AS tgt FROM dict_words),
dict AS (
  SELECT DISTINCT ON (word) word, repl FROM (
    SELECT item_id, p, 0 AS side, trim(src) AS word, trim(tgt) AS repl FROM dict_rows
    UNION ALL SELECT item_id, p, 1, trim(tgt), trim(src) FROM dict_rows) ORDER BY word, item_id DESC, p DESC, side DESC)"""


def keyword_rows(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    exploded = scan(spark, folder, "benchmark").select("item_id", F.posexplode(words).alias("p", "src"))
    return exploded.select(
        F.struct("item_id", "p").alias("row_no"),
        "src",
        F.concat(F.left("src", F.lit(1)), F.right("src", F.lit(1)), F.lit("o")).alias("tgt"),
    )


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_dictionary(keyword_rows(spark, folder), F.col("row_no"))


# Round-trip pairs: documents substituted forward, then backward with the colliding dictionary.
def pairs_sql() -> str:
    from backglot.plans import sqltext as q

    return ",\n".join(
        [
            DICT,
            q.substituted("fwd", "documents", "text", SOURCE, TARGET),
            q.substituted("bwd", "fwd_doc", "out", TARGET, SOURCE),
            "pairs AS (SELECT d.doc_id, d.lang, d.source, d.text AS original, f.out AS translated, b.out AS back"
            " FROM documents d JOIN fwd_doc f USING (doc_id) JOIN bwd_doc b USING (doc_id))",
        ]
    )


def words_for(spark: SparkSession, folder: str) -> DataFrame | Lookup:
    """The dictionary, resolved once for both directions (they share their word characters)."""
    table = usable_entries(dictionary(spark, folder), FORWARD)
    return inline_lookup(table) or table


def pairs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return pairs_of(documents(spark, folder, *columns), words_for(spark, folder))


def pairs_of(docs: DataFrame, words: DataFrame | Lookup) -> DataFrame:
    rows = docs.withColumnRenamed("text", "original")
    forward = substitute_documents(rows, "doc_id", "original", "translated", words, FORWARD)
    return substitute_documents(forward, "doc_id", "translated", "back", words, BACKWARD)


# Translation memory: benchmark words, answered by their reversal;
# words ending in 'n' get a two-word answer and words ending in 'd' a hyphenated one.
# A second language pair in the same table answers the same phrases differently, and a third
# holds the way back: the accented words of the Spanish and French documents.
MEMORY = """memory AS (
  SELECT DISTINCT word AS phrase,
         reverse(word) || CASE word[-1:] WHEN 'n' THEN ' ' || word[1] WHEN 'd' THEN '-' || word[1] ELSE '' END AS translation
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark))"""
BACK_MEMORY = """back_memory AS (
  SELECT DISTINCT word AS phrase, 'w' || length(word) || ' ' || word AS translation
  FROM (SELECT unnest(regexp_extract_all(text, '[à-öø-ÿ]+')) AS word FROM documents WHERE lang IN ('es', 'fr')))"""


def memory(spark: SparkSession, folder: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("phrase")
    distinct = scan(spark, folder, "benchmark").select(words).distinct()
    end, first = F.right("phrase", F.lit(1)), F.left("phrase", F.lit(1))
    suffix = (
        F.when(end == "n", F.concat(F.lit(" "), first)).when(end == "d", F.concat(F.lit("-"), first)).otherwise("")
    )
    pair = lambda src, tgt: (F.lit(src).alias("src"), F.lit(tgt).alias("tgt"))
    own = distinct.select(*pair(SOURCE, TARGET), "phrase", F.concat(F.reverse("phrase"), suffix).alias("translation"))
    other = distinct.select(*pair(SOURCE, "fr"), "phrase", F.upper("phrase").alias("translation"))
    accented = F.explode(F.regexp_extract_all("text", F.lit("[à-öø-ÿ]+"), F.lit(0))).alias("phrase")
    back = scan(spark, folder, "documents").where(F.col("lang").isin("es", "fr")).select(accented).distinct()
    answer = F.concat(F.lit("w"), F.length("phrase").cast("string"), F.lit(" "), F.col("phrase"))
    return own.union(other).union(back.select(*pair(TARGET, SOURCE), "phrase", answer.alias("translation")))


# Few-shot examples: benchmark texts in item order with their reversed text.
EXAMPLES = """examples AS (
  SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id, text AS src, reverse(text) AS tgt FROM benchmark)"""


def examples(spark: SparkSession, folder: str) -> DataFrame:
    from backglot.operators.positions import with_position

    rows = scan(spark, folder, "benchmark").select("item_id", "text")
    return with_position(rows, "item_id").select("pos", F.col("text").alias("src"), F.reverse("text").alias("tgt"))


# Answers: assistant turns, wrapped by turn number in a tagged fence, a bare fence or none.
RESPONSES = """responses AS (
  SELECT conv_id, turn, CASE
      WHEN role = 'system' THEN '  '
      WHEN turn % 4 = 1 THEN 'Sure:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
      WHEN turn % 4 = 3 THEN '```' || chr(10) || text || chr(10) || '``` ok' ELSE ' ' || text || ' ' END AS response
  FROM conversations)"""


def responses(spark: SparkSession, folder: str) -> DataFrame:
    text, turn = F.col("text"), F.col("turn")
    response = (
        F.when(F.col("role") == "system", "  ")
        .when(turn % 4 == 1, F.concat(F.lit("Sure:\n```python\n"), text, F.lit("\n```\nDone.")))
        .when(turn % 4 == 3, F.concat(F.lit("```\n"), text, F.lit("\n``` ok")))
        .otherwise(F.concat(F.lit(" "), text, F.lit(" ")))
    )
    return scan(spark, folder, "conversations").select("conv_id", "turn", "role", response.alias("response"))


# Score rows: one per document, cheap numbers in the shape of evaluation results.
SCORE_COLUMNS = {
    "bleu_score": "(n_chars % 101) / 100.0",
    "syntax_valid_rate": "(n_chars % 11) * 10.0",
    "structure_score": "(n_chars % 53) / 52.0",
    "semantic_score": "(n_chars % 97) / 96.0",
    "token_match": "(n_chars % 29) / 28.0",
    "overall": "(n_chars % 89) / 88.0",
}
SCORES = f"""scores AS (
  SELECT doc_id AS pos, source AS model, lang || ' (' || upper(lang) || ')' AS language,
         CAST(doc_id % 5 * 5 AS DOUBLE) AS examples,
         {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in SCORE_COLUMNS.items())}
  FROM documents)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "documents").selectExpr(
        "doc_id AS pos",
        "source AS model",
        "concat(lang, ' (', upper(lang), ')') AS language",
        "CAST(doc_id % 5 * 5 AS DOUBLE) AS examples",
        *[f"CAST({e.replace('.0', 'D')} AS DOUBLE) AS {c}" for c, e in SCORE_COLUMNS.items()],
    )


# Raw report sheets: one per document source. A title row, a header row, then one row per
# document: the language only on some rows, numbers as untidy strings.
HEADER = ["Language", "No of Examples", *REPORT_HEADERS]
_CELLS = ["n_chars % 101", "n_chars % 11", "n_chars % 53", "n_chars % 97", "n_chars % 29", "n_chars % 89"]
REPORT = f"""sheets AS (
  SELECT source AS report, 2 * doc_id + 2 AS pos,
    [CASE WHEN n_chars % 3 = 0 THEN lang || ' (' || upper(lang) || ')' WHEN n_chars % 3 = 1 THEN '' END,
     CASE WHEN n_chars % 7 > 0 THEN (doc_id % 5 * 5) || '' END,
     {", ".join(f"'0,' || ({c}) || chr(10)" for c in _CELLS)}] AS cells FROM documents
  UNION ALL SELECT DISTINCT source, 0, ['Table 1', NULL, NULL, NULL, NULL, NULL, NULL, NULL] FROM documents
  UNION ALL SELECT DISTINCT source, 1, [{", ".join(f"'{h}'" for h in HEADER)}] FROM documents)"""


def report_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    language = F.expr(
        "CASE WHEN n_chars % 3 = 0 THEN concat(lang, ' (', upper(lang), ')') WHEN n_chars % 3 = 1 THEN '' END"
    )
    count = F.expr("CASE WHEN n_chars % 7 > 0 THEN CAST(doc_id % 5 * 5 AS STRING) END")
    metrics = [F.concat(F.lit("0,"), F.expr(c).cast("string"), F.lit("\n")) for c in _CELLS]
    body = rows.select(
        F.col("source").alias("report"),
        (F.col("doc_id") * 2 + 2).alias("pos"),
        F.array(language, count, *metrics).alias("cells"),
    )

    def extra(position: int, cells: list[Column]) -> DataFrame:
        return rows.select(F.col("source").alias("report")).distinct().select(
            "report", F.lit(position).cast("long").alias("pos"), F.array(*cells).alias("cells")
        )

    none = F.lit(None).cast("string")
    title = extra(0, [F.lit("Table 1"), *[none] * 7])
    return body.unionByName(title).unionByName(extra(1, [F.lit(h) for h in HEADER]))
