"""Stage 1: translation through a translation-memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backglot.functions.expr import bind
from backglot.functions.languages import is_target_language, is_translatable
from backglot.functions.lexing import Lexer, comment_text, is_comment_piece
from backglot.operators.lookup import lookup_join
from backglot.operators.substitution import INLINE_ROWS, comment_split, line_table, rewrite_pieces, token_table
from backglot.sources.tables import hand_over

_BLANK = r"(?U)^[\s\x1c-\x1f_]*\z"


def phrase_of(text: Column) -> Column:
    """What the translator is asked for; null for blank text, which passes through."""
    phrase = F.replace(text, F.lit("_"), F.lit(" "))
    return F.when(~text.rlike(_BLANK), phrase)


def answer_of(phrase: Column, hit: Column) -> Column:
    """Translator answer: hyphens become underscores; no hit gives the phrase back."""
    return F.coalesce(F.replace(hit, F.lit("-"), F.lit("_")), phrase)


def identifier_of(word: Column, phrase: Column, hit: Column) -> Column:
    """Answer as an identifier; empty answers and blank phrases keep the word."""
    name = F.replace(answer_of(phrase, hit), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), word)


def comment_phrase(comment: Column, target: str) -> Column:
    """Comment text to translate; null when bare or already in the target language."""

    def pick(text: Column) -> Column:
        return F.when((text != "") & ~is_target_language(text, target), text)

    return bind(comment_text(comment), pick)


def comment_answer(comment: Column, phrase: Column, hit: Column) -> Column:
    return F.when(phrase.isNotNull(), F.concat(F.lit("# "), answer_of(phrase, hit))).otherwise(comment)


def phrase_table(df: DataFrame, key: str, text: str, lexer: Lexer) -> DataFrame:
    """``(key, ln, p, word, phrase)`` for every word token that has to be translated."""
    value = F.col("value")
    words = token_table(df, key, text, lexer).where(lexer.is_word(value) & is_translatable(value, lexer.target))
    return words.where(~value.rlike(_BLANK)).select(key, "ln", "p", value.alias("word"), phrase_of(value).alias("phrase"))


def comment_table(df: DataFrame, key: str, text: str, lexer: Lexer) -> DataFrame:
    """``(key, ln, comment, phrase)`` for every comment that has to be translated."""
    lines = comment_split(line_table(df, key, text))
    comments = lines.select(key, "ln", "comment", comment_phrase(F.col("comment"), lexer.target).alias("phrase"))
    return comments.where(F.col("phrase").isNotNull())


def pair_memory(memory: DataFrame, lexer: Lexer) -> DataFrame:
    """``(phrase, translation)`` of a memory ``(src, tgt, phrase, translation)`` for the lexer's languages.

    Of several translations of a phrase the least counts.
    """
    own = memory.where((F.col("src") == lexer.source) & (F.col("tgt") == lexer.target) & F.col("phrase").isNotNull())
    return own.groupBy("phrase").agg(F.min("translation").alias("translation"))


def phrase_demand(df: DataFrame, key: str, text: str, memory: DataFrame, lexer: Lexer) -> DataFrame:
    """``(src, tgt, phrase, uses)``: distinct phrases of words and comments that the memory does not hold.

    Counting first makes both join sides unique, so a hot phrase costs one row.
    """
    phrases = phrase_table(df, key, text, lexer).select("phrase").unionByName(comment_table(df, key, text, lexer).select("phrase"))
    wanted = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("uses"))
    missing = wanted.join(pair_memory(memory, lexer).select("phrase"), "phrase", "left_anti")
    return missing.select(F.lit(lexer.source).alias("src"), F.lit(lexer.target).alias("tgt"), "phrase", "uses")


def memory_lookup(phrases: DataFrame, memory: DataFrame, lexer: Lexer, row_id: list[str]) -> DataFrame:
    """Add ``translated``: the memory's answer for the lexer's languages, or the phrase itself."""
    table = hand_over(pair_memory(memory, lexer), "memory")
    joined = lookup_join(phrases, table, "phrase", row_id)
    return joined.withColumn("translated", answer_of(F.col("phrase"), F.col("translation"))).drop("translation")


def translate_documents(
    df: DataFrame, key: str, text: str, out: str, memory: DataFrame, lexer: Lexer, inline_rows: int = INLINE_ROWS
) -> DataFrame:
    """Stage-1 translation of words and comments; a missing result falls back to the input."""
    target = lexer.target

    def wanted(piece: Column) -> Column:
        return F.when(lexer.is_word(piece), F.when(is_translatable(piece, target), phrase_of(piece))).when(
            is_comment_piece(piece), comment_phrase(piece, target)
        )

    def value(piece: Column, phrase: Column, hit: Column) -> Column:
        done = F.when(is_comment_piece(piece), comment_answer(piece, phrase, hit)).otherwise(
            identifier_of(piece, phrase, hit)
        )
        return F.when(phrase.isNull(), piece).otherwise(done)

    table = pair_memory(memory, lexer).select(F.col("phrase").alias("word"), F.col("translation").alias("repl"))
    done = rewrite_pieces(df, key, text, out, lexer, table, wanted, value, tidy_comments=False, inline_rows=inline_rows)
    return done.withColumn(out, F.coalesce(out, text))
