"""Column functions for corpus text and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from backglot.functions.expr import bind

FENCE = "```"
# A snippet counts as code when it holds one of these.
CODE_KEYWORDS = ["def ", "class ", "import ", "print", "for", "while"]

_STRIP = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_RSTRIP = r"(?U)[\s\x1c-\x1f]+\z"
_FLOAT = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\z"


def strip(text: Column) -> Column:
    """Strip all Unicode white space (``trim`` only knows the blank)."""
    return F.regexp_replace(text, _STRIP, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, _RSTRIP, "")


def has_code_keyword(code: Column) -> Column:
    found = F.lit(False)
    for keyword in CODE_KEYWORDS:
        found = found | F.contains(code, F.lit(keyword))
    return found


def fenced_block(text: Column) -> Column:
    """First fenced Python block, stripped; null without one."""
    pattern = r"(?s)```python(.*?)```"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def extract_code(text: Column) -> Column:
    """First fenced Python block that also looks like code; null otherwise."""
    return bind(fenced_block(text), lambda code: F.when(has_code_keyword(code), code))


def clean_number(cell: Column) -> Column:
    """Report cell to double: decimal commas, stray line breaks, repeated dots, junk around digits."""
    def single_dot(flat: Column) -> Column:
        head = F.substring_index(flat, ".", 1)
        rest = F.replace(F.substring(flat, F.length(head) + 2, F.length(flat)), F.lit("."), F.lit(""))
        return F.when(F.contains(flat, F.lit(".")), F.concat(head, F.lit("."), rest)).otherwise(flat)

    def number(text: Column) -> Column:
        plain = F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit(""))).otherwise(
            F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)", 1), F.lit(""))
        )
        return (
            F.when(text.rlike(r"(?i)^[+-]?nan\z"), F.lit(float("nan")))
            .when(text.rlike(r"(?i)^\+?inf(inity)?\z"), F.lit(float("inf")))
            .when(text.rlike(r"(?i)^-inf(inity)?\z"), F.lit(float("-inf")))
            .otherwise(F.coalesce(plain.try_cast("double"), F.lit(0.0)))
        )

    return bind(bind(strip(F.translate(cell, ",\n", ".")), single_dot), number)


def display_name(name: Column) -> Column:
    """Drop a bracketed remark from a language name."""
    return strip(F.regexp_replace(name, r"\(.*\)", ""))


def clean_response(response: Column, bare_fences: bool) -> Column:
    """Code inside a model answer.

    The first ``python`` fence wins. ``bare_fences`` also accepts an untagged fence
    (and lets an empty answer through as it is).
    """

    def after(text: Column, mark: str) -> Column:
        return F.get(F.split(text, mark, -1), F.lit(1))

    def pick(text: Column) -> Column:
        tagged = strip(F.get(F.split(after(text, "```python"), FENCE, -1), F.lit(0)))
        cleaned = F.when(F.contains(text, F.lit("```python")), tagged)
        if bare_fences:
            cleaned = cleaned.when(F.contains(text, F.lit(FENCE)), strip(after(text, FENCE)))
        return cleaned.otherwise(text)

    return bind(strip(response), pick)
