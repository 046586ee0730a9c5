"""DuckDB SQL building blocks: the independent twin of the Spark plans, for checking results.

RE2 has no possessive quantifiers and no ``(?U)`` Unicode switch, so it gets its own patterns.
"""

from __future__ import annotations

from backglot.functions.languages import RESERVED_WORDS, WORD_CHARS
from backglot.functions.lexing import SINGLE_OPERATORS, STAGE0_OPERATORS, STAGE1_OPERATORS


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


COMMENT = text(r"""(?s)^((?:[^"'#]|"[^"]*"|'[^']*')*)(#.*)$""")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\x1c-\x1f]+$', '')"


def word_class(source: str, target: str) -> str:
    return rf"[{WORD_CHARS[source]}{WORD_CHARS[target]}\d_]"


def token_pattern(source: str, target: str, stage: int, gaps: bool = False) -> str:
    def quote(symbol: str) -> str:
        return "".join("\\" + c for c in symbol)

    ops = "|".join(quote(o) for o in (STAGE1_OPERATORS if stage else STAGE0_OPERATORS))
    singles = "".join("\\" + c for c in SINGLE_OPERATORS)
    strings = r""""(?:\\.|[^"])*"?|'(?:\\.|[^'])*'?"""
    rest = "|(?s:.)" if gaps else ""
    return text(rf"[\s\x1c-\x1f]+|{strings}|{ops}|[{singles}]|{word_class(source, target)}+{rest}")


def is_word(x: str, source: str, target: str) -> str:
    return f"regexp_matches({x}, {text('^' + word_class(source, target))})"


def is_target(x: str, target: str) -> str:
    """Spanish, French or English as target."""
    letters = {"en": "a-zA-Z"}.get(target) or WORD_CHARS[target].removeprefix("a-zA-Z")
    return f"(regexp_matches({x}, '^\\p{{Nd}}+$') OR regexp_matches({x}, '[{letters}]'))"


def is_translatable(x: str, target: str) -> str:
    reserved = ", ".join(text(w) for w in RESERVED_WORDS)
    return f"(NOT {is_target(x, target)} AND {x} NOT IN ({reserved}))"


def parts(name: str, src: str, key: str, column: str) -> str:
    """CTEs ``{name}_parts(key, ln, line, blank, indent, body, code, comment)``."""
    return rf"""
{name}_lines AS (
  SELECT {key}, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ln
  FROM (SELECT {key}, string_split({column}, chr(10)) AS l FROM {src})
),
{name}_bodies AS (
  SELECT {key}, ln, line, regexp_matches(line, '^[\s\x1c-\x1f]*$') AS blank,
         regexp_extract(line, '^([\s\x1c-\x1f]*)', 1) AS indent,
         regexp_replace(line, '^[\s\x1c-\x1f]+', '') AS body
  FROM {name}_lines
),
{name}_parts AS (
  SELECT *, CASE WHEN regexp_matches(body, {COMMENT}) THEN {rstrip(f"regexp_extract(body, {COMMENT}, 1)")} ELSE body END AS code,
         regexp_extract(body, {COMMENT}, 2) AS comment
  FROM {name}_bodies
)"""


def tokens(name: str, source: str, target: str, stage: int) -> str:
    """CTE ``{name}_tok(key columns, ln, p, value)`` from ``{name}_parts``."""
    return f"""
{name}_tok AS (
  SELECT doc_id, ln, unnest(t) AS value, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS p
  FROM (SELECT doc_id, ln, regexp_extract_all(code, {token_pattern(source, target, stage)}) AS t
        FROM {name}_parts WHERE NOT blank)
)"""


def documents_from(name: str, code_sql: str, comment_sql: str) -> str:
    """CTE ``{name}_doc(doc_id, out)``: tokens back to lines back to documents."""
    return f"""
{name}_code AS ({code_sql}),
{name}_doc AS (
  SELECT doc_id, string_agg(
      CASE WHEN blank THEN line
           ELSE indent || coalesce(new_code, '') || CASE WHEN comment = '' THEN '' ELSE ' ' || {comment_sql} END END,
      chr(10) ORDER BY ln) AS out
  FROM {name}_parts LEFT JOIN {name}_code USING (doc_id, ln) GROUP BY doc_id
)"""


def substituted(name: str, src: str, column: str, source: str, target: str, dictionary: str = "dict") -> str:
    """CTEs ending in ``{name}_doc(doc_id, out)``: dictionary substitution of whole documents."""
    comment = f"CASE WHEN {strip('comment[2:]')} = '' THEN comment ELSE '#' || {strip('comment[2:]')} END"
    code = f"""
  SELECT doc_id, ln, string_agg(coalesce(repl, value), '' ORDER BY p) AS new_code
  FROM {name}_tok LEFT JOIN {dictionary} ON value = word AND {is_word('value', source, target)}
  GROUP BY doc_id, ln"""
    return ",".join(
        [
            parts(name, src, "doc_id", column),
            tokens(name, source, target, 0),
            documents_from(name, code, comment),
        ]
    )


def bleu(name: str, src: str, key: str, reference: str, candidate: str) -> str:
    """CTE ``{name}_bleu(key, bleu_score)`` from two list columns of ``src``."""

    def grams(column: str, side: str) -> str:
        per_n = " UNION ALL ".join(
            f"SELECT {key}, {n} AS n, array_to_string({column}[i:i + {n - 1}], chr(1)) AS g "
            f"FROM (SELECT {key}, {column}, unnest(range(1, len({column}) - {n} + 2)) AS i FROM {src})"
            for n in range(1, 5)
        )
        return f"{name}_{side} AS (SELECT {key}, n, g, count(*) AS c FROM ({per_n}) GROUP BY ALL)"

    hits = ", ".join(f"coalesce(sum(least(c.c, coalesce(r.c, 0))) FILTER (c.n = {n}), 0) AS h{n}" for n in range(1, 5))
    logs = " + ".join(
        f"ln(CASE WHEN h{n} > 0 THEN h{n} / greatest(1, cl - {n - 1}) ELSE 2.2250738585072014e-308::DOUBLE END) / 4"
        for n in range(1, 5)
    )
    return f"""
{grams(candidate, "c")},
{grams(reference, "r")},
{name}_hits AS (
  SELECT {key}, {hits} FROM {name}_c c LEFT JOIN {name}_r r USING ({key}, n, g) GROUP BY {key}
),
{name}_bleu AS (
  SELECT {key}, CASE WHEN coalesce(h1, 0) = 0 THEN 0.0
      ELSE CASE WHEN cl > rl THEN 1.0 ELSE exp(1 - rl / cl) END * exp({logs}) END AS bleu_score
  FROM (SELECT {key}, CAST(len({candidate}) AS DOUBLE) AS cl, CAST(len({reference}) AS DOUBLE) AS rl FROM {src})
  LEFT JOIN {name}_hits USING ({key})
)"""
