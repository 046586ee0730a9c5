"""Registered queries: dictionaries, lines, tokens, substitution, stage-1 translation."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.languages import LANGUAGES, MISSING_KEY, WORD_CHARS, is_target_language, is_translatable, with_language
from backglot.functions.lexing import comment_part, stage0_lexer
from backglot.operators import memory as mem
from backglot.operators import substitution as sub
from backglot.operators.lookup import lookup_join
from backglot.operators.memory_store import MemoryStore
from backglot.plans import inputs
from backglot.plans import sqltext as q
from backglot.plans.inputs import SOURCE, TARGET
from backglot.session import scratch_path, shuffle_partitions
from backglot.sources.tables import scan

PARTS = q.parts("d", "documents", "doc_id", "text")
TOKENS0 = q.tokens("d", SOURCE, TARGET, 0)
TOKENS1 = q.tokens("d", SOURCE, TARGET, 1)
TYPE_SQL = rf"""CASE WHEN regexp_matches(value, '^[\s\x1c-\x1f]') THEN 'space'
  WHEN regexp_matches(value, '^["'']') THEN 'string' WHEN {q.is_word("value", SOURCE, TARGET)} THEN 'word'
  ELSE 'operator' END"""


def keyword_dict(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.dictionary(spark, folder)


def lang_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "documents").select("doc_id", F.col("lang").alias("code"))
    return with_language(rows, "code")


def line_table(spark: SparkSession, folder: str) -> DataFrame:
    return sub.line_table(inputs.documents(spark, folder), "doc_id", "text")


def comment_split(spark: SparkSession, folder: str) -> DataFrame:
    split = sub.comment_split(sub.line_table(inputs.documents(spark, folder), "doc_id", "text"))
    return split.select("doc_id", "ln", "code", "comment")


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    return sub.token_table(inputs.documents(spark, folder), "doc_id", "text", inputs.FORWARD)


def token_table_ext(spark: SparkSession, folder: str) -> DataFrame:
    return sub.token_table(inputs.documents(spark, folder), "doc_id", "text", inputs.STAGE1_FORWARD)


def keyword_substitute(spark: SparkSession, folder: str) -> DataFrame:
    return sub.substitute_tokens(
        token_table(spark, folder), inputs.dictionary(spark, folder), ["doc_id", "ln", "p"]
    )


def substitute_document(spark: SparkSession, folder: str) -> DataFrame:
    """The join plan, with the large keyword table."""
    words = inputs.dictionary(spark, folder)
    docs = inputs.documents(spark, folder)
    done = sub.substitute_documents(docs, "doc_id", "text", "out", words, inputs.FORWARD, inline_rows=0)
    return done.select("doc_id", "out")


def partial_forward(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    words = inputs.words_for(spark, folder)
    return sub.substitute_documents(docs, "doc_id", "text", "partial", words, inputs.FORWARD).drop("text")


def gap_substitute(spark: SparkSession, folder: str) -> DataFrame:
    """Substitution that keeps every character outside the words; ``same``: what an empty dictionary gives is the text."""
    lexer = stage0_lexer(SOURCE, TARGET, keep_gaps=True)
    docs = inputs.documents(spark, folder)
    words = inputs.words_for(spark, folder)
    done = sub.substitute_documents(docs, "doc_id", "text", "partial", words, lexer)
    nothing = spark.createDataFrame([], "word string, repl string")
    done = sub.substitute_documents(done, "doc_id", "text", "kept", nothing, lexer)
    return done.select("doc_id", "partial", (F.col("kept") == F.col("text")).alias("same"))


def stored_memory(spark: SparkSession, folder: str) -> MemoryStore:
    """The test memory in two versions: the second answers phrases up to "m" anew and adds capitals of the keywords."""
    path = scratch_path(spark, "memory")
    store = MemoryStore(spark, path, os.path.basename(path).replace("-", "_"), shuffle_partitions(spark))
    first = inputs.memory(spark, folder)
    store.upsert(first, 1)
    again = first.where((F.col("src") == SOURCE) & (F.col("tgt") == TARGET) & (F.left("phrase", F.lit(1)) <= "m"))
    store.upsert(again.withColumn("translation", F.concat(F.lit("new-"), "translation")), 2)
    store.upsert(again.withColumns({"phrase": F.upper("phrase"), "translation": F.col("phrase")}), 2)
    return store


def memory_demand_stored(spark: SparkSession, folder: str) -> DataFrame:
    return stored_memory(spark, folder).demand(inputs.documents(spark, folder), "doc_id", "text", inputs.STAGE1_FORWARD)


def memory_lookup_stored(spark: SparkSession, folder: str) -> DataFrame:
    phrases = mem.phrase_table(inputs.documents(spark, folder), "doc_id", "text", inputs.STAGE1_FORWARD)
    found = stored_memory(spark, folder).lookup(phrases, inputs.STAGE1_FORWARD, ["doc_id", "ln", "p"])
    return found.select("doc_id", "ln", "p", "word", "translated")


def partial_backward(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.pairs(spark, folder).select("doc_id", "translated", F.col("back").alias("partial_back"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    tokens = sub.token_table(inputs.documents(spark, folder), "doc_id", "text", inputs.STAGE1_FORWARD)
    return tokens.where(F.col("type") == "word").groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("uses"))


def script_flag(spark: SparkSession, folder: str) -> DataFrame:
    flags = [is_target_language(F.col("word"), t).alias(f"is_{t}") for t in ("en", "es", "fr")]
    return _words(spark, folder).select("word", *flags)


# Letters that stand for "aeiost" in words of other scripts, and a digit of the script for "n" where it has its own.
SCRIPTS = {"hi": ("अआइईउऊ", "०"), "bn": ("অআইঈউঊ", "০"), "zh-CN": ("一丁七万丈三", ""), "el": ("αεηιοω", ""), "ku": ("ابتثجح", "٠")}


def _spelled(letters: str, digit: str) -> tuple[str, str]:
    return "aeiost" + ("n" if digit else ""), letters + digit


def script_flag_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents spelled with letters and digits of five other scripts, and whether they show each script."""
    words = _words(spark, folder).select("word")
    spelled = [(t, F.translate("word", *_spelled(*SCRIPTS[t])).alias("spelled")) for t in SCRIPTS]
    rows = [words.select("word", F.lit(t).alias("script"), column) for t, column in spelled]
    flags = [is_target_language(F.col("spelled"), t).alias(f"is_{t[:2]}") for t in SCRIPTS]
    return reduce(DataFrame.unionByName, rows).select("word", "script", "spelled", *flags)


def translatable_words(spark: SparkSession, folder: str) -> DataFrame:
    return _words(spark, folder).where(is_translatable(F.col("word"), TARGET))


def phrase_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Snake-case names made of each document's words: to phrase and back."""
    name = F.concat(F.lit("_"), F.regexp_replace("text", r"[^\p{L}\p{N}]+", "_"))
    rows = inputs.documents(spark, folder).select("doc_id", name.alias("name"))
    phrase = mem.phrase_of(F.col("name"))
    hit = F.concat(F.col("phrase"), F.lit(" - end"))
    return rows.select("doc_id", "name", phrase.alias("phrase")).select(
        "doc_id", "phrase", mem.identifier_of(F.col("name"), F.col("phrase"), hit).alias("restored")
    )


def phrase_demand(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    return mem.phrase_demand(docs, "doc_id", "text", inputs.memory(spark, folder), inputs.STAGE1_FORWARD)


def tm_lookup(spark: SparkSession, folder: str) -> DataFrame:
    phrases = mem.phrase_table(inputs.documents(spark, folder), "doc_id", "text", inputs.STAGE1_FORWARD)
    found = mem.memory_lookup(phrases, inputs.memory(spark, folder), inputs.STAGE1_FORWARD, ["doc_id", "ln", "p"])
    return found.select("doc_id", "ln", "p", "word", "translated")


def comment_translate(spark: SparkSession, folder: str) -> DataFrame:
    """Comments of all lines; the memory answers those with an "a" by their reversed text."""
    lines = sub.comment_split(sub.line_table(inputs.documents(spark, folder), "doc_id", "text"))
    comments = lines.where(F.col("comment") != "").select(
        "doc_id", "ln", "comment", mem.comment_phrase(F.col("comment"), TARGET).alias("phrase")
    )
    known = scan(spark, folder, "documents").select(
        F.explode(F.split("text", "\n", -1)).alias("line")
    )
    texts = known.select(mem.comment_phrase(comment_part(F.ltrim("line")), TARGET).alias("phrase"))
    answers = texts.where(F.col("phrase").isNotNull() & F.contains("phrase", F.lit("a"))).distinct()
    answers = answers.select("phrase", F.concat(F.reverse("phrase"), F.lit("-x")).alias("translation"))
    joined = lookup_join(comments, answers, "phrase", ["doc_id", "ln"])
    done = mem.comment_answer(F.col("comment"), F.col("phrase"), F.col("translation"))
    return joined.select("doc_id", "ln", done.alias("translated"))


def stage1_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Stage 1 over the partial text."""
    docs = inputs.documents(spark, folder)
    partial = sub.substitute_documents(docs, "doc_id", "text", "partial", inputs.words_for(spark, folder), inputs.FORWARD)
    done = mem.translate_documents(
        partial, "doc_id", "partial", "translated", inputs.memory(spark, folder), inputs.STAGE1_FORWARD
    )
    return done.select("doc_id", "translated")


def stage1_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Stage-1 output on the way back to English, by the join plan: words with an ASCII letter count as English."""
    forward, memory = stage1_forward(spark, folder), inputs.memory(spark, folder)
    done = mem.translate_documents(forward, "doc_id", "translated", "back", memory, inputs.STAGE1_BACKWARD, inline_rows=0)
    return done.select("doc_id", "back")


WORD_SQL = f"words AS (SELECT value AS word, count(*) AS uses FROM d_tok WHERE {q.is_word('value', SOURCE, TARGET)} GROUP BY value)"
PHRASES = f"""phrases AS (
  SELECT doc_id, ln, p, value AS word, replace(value, '_', ' ') AS phrase FROM d_tok
  WHERE {q.is_word("value", SOURCE, TARGET)} AND {q.is_translatable("value", TARGET)} AND trim(replace(value, '_', ' ')) <> '')"""
KEPT = q.strip("comment[2:]")


def comment_phrase_sql(target: str) -> str:
    return f"CASE WHEN {KEPT} <> '' AND NOT {q.is_target(KEPT, target)} THEN {KEPT} END"


def translated_sql(name: str, source: str, target: str, memory: str) -> str:
    """CTE ``{name}_doc``: stage-1 translation of ``{name}_parts`` through ``memory``."""
    phrase = (
        f"CASE WHEN {q.is_word('value', source, target)} AND {q.is_translatable('value', target)} "
        "AND trim(replace(value, '_', ' ')) <> '' THEN replace(value, '_', ' ') END"
    )
    code = f"""
  SELECT doc_id, ln, string_agg(CASE WHEN k.phrase IS NULL THEN value
      ELSE coalesce(nullif(replace(coalesce(replace(translation, '-', '_'), k.phrase), ' ', '_'), ''), value) END,
      '' ORDER BY p) AS new_code
  FROM (SELECT *, {phrase} AS phrase FROM {name}_tok) k LEFT JOIN {memory} m ON k.phrase = m.phrase GROUP BY doc_id, ln"""
    comment = (
        f"coalesce('# ' || coalesce((SELECT replace(m.translation, '-', '_') FROM {memory} m "
        f"WHERE m.phrase = {comment_phrase_sql(target)}), {comment_phrase_sql(target)}), comment)"
    )
    return ",".join([q.tokens(name, source, target, 1), q.documents_from(name, code, comment)])


FORWARD1 = f"""{inputs.DICT}, {inputs.MEMORY}, {q.substituted("s", "documents", "text", SOURCE, TARGET)},
  {q.parts("d", "s_doc", "doc_id", "out")}, {translated_sql("d", SOURCE, TARGET, "memory")}"""
BACKWARD1 = f"""{FORWARD1}, {inputs.BACK_MEMORY}, {q.parts("b", "d_doc", "doc_id", "out")},
  {translated_sql("b", TARGET, SOURCE, "back_memory")}"""

GROWN = f"""{inputs.MEMORY}, grown AS (
  SELECT phrase, CASE WHEN phrase[1] <= 'm' THEN 'new-' ELSE '' END || translation AS translation FROM memory
  UNION ALL SELECT upper(phrase), phrase FROM memory WHERE phrase[1] <= 'm')"""
GAPS = f"""{inputs.DICT}, {PARTS},
g_tok AS (SELECT doc_id, ln, unnest(t) AS value, generate_subscripts(t, 1) AS p FROM (
  SELECT doc_id, ln, regexp_extract_all(left(body, length(body) - length(comment)), {q.token_pattern(SOURCE, TARGET, 0, True)}) AS t
  FROM d_parts WHERE NOT blank)),
g_code AS (SELECT doc_id, ln, string_agg(coalesce(repl, value), '' ORDER BY p) AS new_code FROM g_tok
  LEFT JOIN dict ON value = word AND {q.is_word('value', SOURCE, TARGET)} GROUP BY doc_id, ln)"""

QUERIES = {
    "gap_substitute": (
        gap_substitute,
        f"""WITH {GAPS} SELECT doc_id, string_agg(CASE WHEN blank THEN line ELSE indent || coalesce(new_code, '') || comment END,
  chr(10) ORDER BY ln) AS partial, true AS same FROM d_parts LEFT JOIN g_code USING (doc_id, ln) GROUP BY doc_id""",
    ),
    "memory_demand_stored": (
        memory_demand_stored,
        f"""WITH {GROWN}, {PARTS}, {TOKENS1}, {PHRASES}
SELECT '{SOURCE}' AS src, '{TARGET}' AS tgt, phrase, count(*) AS uses FROM (
  SELECT phrase FROM phrases UNION ALL SELECT {comment_phrase_sql(TARGET)} FROM d_parts WHERE comment <> '')
WHERE phrase IS NOT NULL AND phrase NOT IN (SELECT phrase FROM grown) GROUP BY phrase""",
    ),
    "memory_lookup_stored": (
        memory_lookup_stored,
        f"""WITH {GROWN}, {PARTS}, {TOKENS1}, {PHRASES}
SELECT doc_id, ln, p, word, coalesce(replace(translation, '-', '_'), phrase) AS translated
FROM phrases LEFT JOIN grown USING (phrase)""",
    ),
    "keyword_dict": (keyword_dict, f"WITH {inputs.DICT} SELECT word, repl FROM dict"),
    "lang_lookup": (
        lang_lookup,
        "WITH dim(code, header, name) AS (VALUES "
        + ", ".join(f"('{c}', '{h}', '{n}')" for c, h, n in LANGUAGES)
        + f""") SELECT doc_id, lang AS code, coalesce(header, lang || '{MISSING_KEY}') AS header,
  coalesce(name, lang || '{MISSING_KEY}') AS name FROM documents LEFT JOIN dim ON lang = code""",
    ),
    "line_table": (
        line_table,
        f"WITH {PARTS} SELECT doc_id, ln, CASE WHEN blank THEN line ELSE indent END AS indent,"
        " CASE WHEN blank THEN '' ELSE body END AS body FROM d_parts",
    ),
    "comment_split": (
        comment_split,
        f"WITH {PARTS} SELECT doc_id, ln, CASE WHEN blank THEN '' ELSE code END AS code, comment FROM d_parts",
    ),
    "token_table": (token_table, f"WITH {PARTS}, {TOKENS0} SELECT doc_id, ln, p, {TYPE_SQL} AS type, value FROM d_tok"),
    "token_table_ext": (
        token_table_ext,
        f"WITH {PARTS}, {TOKENS1} SELECT doc_id, ln, p, {TYPE_SQL} AS type, value FROM d_tok",
    ),
    "keyword_substitute": (
        keyword_substitute,
        f"""WITH {inputs.DICT}, {PARTS}, {TOKENS0}, typed AS (SELECT doc_id, ln, p, {TYPE_SQL} AS type, value FROM d_tok)
SELECT doc_id, ln, p, type, coalesce(repl, value) AS value FROM typed LEFT JOIN dict ON type = 'word' AND value = word""",
    ),
    "substitute_document": (
        substitute_document,
        f"WITH {inputs.DICT}, {q.substituted('s', 'documents', 'text', SOURCE, TARGET, 'dict')}"
        " SELECT doc_id, out FROM s_doc",
    ),
    "partial_forward": (
        partial_forward,
        f"WITH {inputs.DICT}, {q.substituted('s', 'documents', 'text', SOURCE, TARGET)}"
        " SELECT doc_id, out AS partial FROM s_doc",
    ),
    "partial_backward": (
        partial_backward,
        f"WITH {inputs.pairs_sql()} SELECT doc_id, translated, back AS partial_back FROM pairs",
    ),
    "script_flag": (
        script_flag,
        f"WITH {PARTS}, {TOKENS1}, {WORD_SQL} SELECT word, {q.is_target('word', 'en')} AS is_en,"
        f" {q.is_target('word', 'es')} AS is_es, {q.is_target('word', 'fr')} AS is_fr FROM words",
    ),
    "script_flag_scripts": (
        script_flag_scripts,
        f"""WITH {PARTS}, {TOKENS1}, {WORD_SQL}, spelled AS ({" UNION ALL ".join(
            f"SELECT word, '{t}' AS script, translate(word, '{_spelled(*SCRIPTS[t])[0]}', '{_spelled(*SCRIPTS[t])[1]}') AS spelled FROM words"
            for t in SCRIPTS
        )}) SELECT word, script, spelled, {", ".join(
            f"(regexp_matches(spelled, '^\\p{{Nd}}+$') OR regexp_matches(regexp_replace(spelled, '\\p{{Nd}}', '', 'g'), '[{WORD_CHARS[t]}]')) AS is_{t[:2]}"
            for t in SCRIPTS
        )} FROM spelled""",
    ),
    "translatable_words": (
        translatable_words,
        f"WITH {PARTS}, {TOKENS1}, {WORD_SQL} SELECT word, uses FROM words WHERE {q.is_translatable('word', TARGET)}",
    ),
    "phrase_normalise": (
        phrase_normalise,
        r"""WITH names AS (SELECT doc_id, '_' || regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g') AS name FROM documents),
phrases AS (SELECT doc_id, name, CASE WHEN trim(replace(name, '_', ' ')) <> '' THEN replace(name, '_', ' ') END AS phrase FROM names)
SELECT doc_id, phrase, coalesce(replace(replace(phrase || ' - end', '-', '_'), ' ', '_'), name) AS restored FROM phrases""",
    ),
    "phrase_demand": (
        phrase_demand,
        f"""WITH {inputs.MEMORY}, {PARTS}, {TOKENS1}, {PHRASES}
SELECT '{SOURCE}' AS src, '{TARGET}' AS tgt, phrase, count(*) AS uses FROM (
  SELECT phrase FROM phrases UNION ALL SELECT {comment_phrase_sql(TARGET)} FROM d_parts WHERE comment <> '')
WHERE phrase IS NOT NULL AND phrase NOT IN (SELECT phrase FROM memory) GROUP BY phrase""",
    ),
    "tm_lookup": (
        tm_lookup,
        f"""WITH {inputs.MEMORY}, {PARTS}, {TOKENS1}, {PHRASES}
SELECT doc_id, ln, p, word, coalesce(replace(translation, '-', '_'), phrase) AS translated
FROM phrases LEFT JOIN memory USING (phrase)""",
    ),
    "comment_translate": (
        comment_translate,
        f"""WITH {PARTS}, keyed AS (SELECT doc_id, ln, comment, {comment_phrase_sql(TARGET)} AS phrase FROM d_parts WHERE comment <> '')
SELECT doc_id, ln, CASE WHEN phrase IS NULL THEN comment WHEN contains(phrase, 'a')
  THEN '# ' || replace(reverse(phrase) || '-x', '-', '_') ELSE '# ' || phrase END AS translated FROM keyed""",
    ),
    "stage1_forward": (stage1_forward, f"WITH {FORWARD1} SELECT doc_id, out AS translated FROM d_doc"),
    "stage1_backward": (stage1_backward, f"WITH {BACKWARD1} SELECT doc_id, out AS back FROM b_doc"),
}
