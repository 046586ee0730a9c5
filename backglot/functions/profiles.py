"""Profiles of a text: tokens, their kinds, name sets, validity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token kinds of prose, in both the profile below and its SQL twin.
NAME_START = "[A-Za-z_À-ÖØ-öø-ÿ]"
NAME = f"{NAME_START}[A-Za-z0-9_À-ÖØ-öø-ÿ]*"
STRING = "\"[^\"\\n]*\"|'[^'\\n]*'"
NUMBER = "[0-9]+(?:\\.[0-9]+)?"
OTHER = "[^\\sA-Za-z0-9_À-ÖØ-öø-ÿ]"
TEXT_TOKEN = f"{NAME}|{NUMBER}|{STRING}|{OTHER}"
# Name sets of prose: words before a comma, capitalised words, connectives.
BEFORE_COMMA = f"({NAME}),"
CAPITALISED = "\\b[A-Z][a-z]+"
CONNECTIVE = "\\b(?:if|for|while|and|or|by)\\b"


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TEXT_TOKEN), F.lit(0))


def is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def is_string(token: Column) -> Column:
    return (F.length(token) > 1) & (F.startswith(token, F.lit('"')) | F.startswith(token, F.lit("'")))


def is_operator(token: Column) -> Column:
    # Plain comparisons first: a regex per token would cost more than the tokens themselves.
    return (F.length(token) == 1) & ((token < "0") | (token >= ":")) & ~token.rlike(f"^{NAME}")


def text_profile(text: Column) -> Column:
    """Regex profile of prose. Balanced brackets and double quotes count as valid."""

    # BEFORE_COMMA without trying again inside a name, and without giving back a name's end.
    before_comma = f"(?<!{NAME_START})({NAME}+),"

    def found(pattern: str, group: int = 0) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))

    def occurrences(symbols: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(symbols), F.lit("")))

    return F.struct(
        ((occurrences("(") == occurrences(")")) & (occurrences('"') % 2 == 0)).alias("valid"),
        found(before_comma, 1).alias("functions"),
        found(CAPITALISED).alias("classes"),
        found(CONNECTIVE).alias("controls"),
    )
