"""Language dimension and script classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language code, keyword-table header, English name.
LANGUAGES = [
    ("fr", "FrenchKey", "French"),
    ("es", "SpanishKey", "Spanish"),
    ("ku", "KurdishKey", "Kurdish"),
    ("en", "EnglishKey", "English"),
    ("hi", "HindiKey", "Hindi"),
    ("bn", "BengaliKey", "Bengali"),
    ("zh-CN", "MandarinKey", "Mandarin"),
    ("el", "GreekKey", "Greek"),
]

# The characters that make up words of each language, as regex class bodies.
WORD_CHARS = {
    "hi": "ऀ-ॿ",
    "bn": "ঀ-৿",
    "zh-CN": "一-鿿",
    "el": "Ͱ-Ͽ",
    "ku": "؀-ۿ",
    "es": "a-zA-ZáéíóúüñÁÉÍÓÚÜÑ",
    "fr": "a-zA-ZàâäéèêëîïôöùûüÿçÀÂÄÉÈÊËÎÏÔÖÙÛÜŸÇ",
    "en": "a-zA-Z",
}
ANY_WORD_CHARS = r"\w"  # languages without a listed script

# Identifiers that stage 1 never translates.
RESERVED_WORDS = ["__init__", "__name__", "__main__", "self", "cls", "args", "kwargs"]

MISSING_KEY = " Key not found"


def canonical(code: str) -> str:
    """``zh`` and ``zh-CN`` name the same script."""
    return "zh-CN" if code == "zh" else code


def word_chars(code: str) -> str:
    return WORD_CHARS.get(canonical(code), ANY_WORD_CHARS)


def language_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, header string, name string")


def with_language(df: DataFrame, code_col: str) -> DataFrame:
    """Add ``header`` and ``name`` of a language code; unknown codes get a marker text.

    The dimension has eight rows, so a broadcast join never grows with the data.
    """
    dim = language_dim(df.sparkSession).withColumnRenamed("code", code_col)
    unknown = F.concat(F.col(code_col), F.lit(MISSING_KEY))
    return (
        df.join(F.broadcast(dim), code_col, "left")
        .withColumn("header", F.coalesce("header", unknown))
        .withColumn("name", F.coalesce("name", unknown))
    )


def language_name(code: str) -> str:
    return {c: n for c, _, n in LANGUAGES}.get(canonical(code), code + MISSING_KEY)


def keyword_header(code: str) -> str:
    return {c: h for c, h, _ in LANGUAGES}.get(canonical(code), code + MISSING_KEY)


def script_pattern(target: str) -> str | None:
    """Regex that finds one character proving a text is already in ``target``."""
    target = canonical(target)
    if target == "en":
        return "[a-zA-ZK]"
    if target in ("es", "fr"):
        return f"[{WORD_CHARS[target].removeprefix('a-zA-Z')}]"
    if target in WORD_CHARS:
        return rf"[{WORD_CHARS[target]}&&[^\p{{Nd}}\s_]]"
    return None


def is_target_language(text: Column, target: str) -> Column:
    """True when the text is all digits or shows the target script."""
    digits = text.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z")
    pattern = script_pattern(target)
    return digits | text.rlike(pattern) if pattern else digits


def is_translatable(word: Column, target: str) -> Column:
    """Stage-1 gate: words that a translator should see."""
    return ~(is_target_language(word, target) | word.isin(RESERVED_WORDS))
