"""Chat formatting: a finite-state machine over roles and a declarative template, all in Spark expressions.

Defined results for odd inputs: a null text or role is the empty string; null turns sort first; ties
of ``turn`` are ordered by role, then text; repeated rows are kept as turns of their own; a null
``conv_id`` is one conversation; an empty table gives an empty result; other columns are ignored.
Conversations whose roles break the order are formatted all the same, with ``valid`` false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.functions.expr import bind
from backglot.sources.tables import scan


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles carry loss, and which role may follow which state."""

    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    loss: tuple = ("assistant",)
    #: (state, role) -> state; the state after a turn is the turn's role.
    order: tuple = (
        ("start", "system"),
        ("start", "user"),
        ("system", "user"),
        ("user", "assistant"),
        ("assistant", "user"),
    )
    accept: tuple = ("assistant",)
    #: control string -> its escape; the escape character itself comes first
    escapes: tuple = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))


def escape(text: Column, template: Template) -> Column:
    """No control string survives in the result, and ``unescape`` restores the text."""
    for raw, coded in template.escapes:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, template: Template) -> Column:
    for raw, coded in reversed(template.escapes):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _name(role: Column, template: Template) -> Column:
    """Template name of a role; a role that the template does not know is written escaped behind ``\\r``."""
    name = F.concat(F.lit("\\r"), F.replace(escape(role, template), F.lit(":"), F.lit("\\c")))
    for known, shown in template.names.items():
        name = F.when(role == known, shown).otherwise(name)
    return name


def _role(name: Column, template: Template) -> Column:
    rest = F.replace(F.substring(name, 3, 1 << 30), F.lit("\\c"), F.lit(":"))
    role = unescape(rest, template)
    for known, shown in template.names.items():
        role = F.when(name == shown, known).otherwise(role)
    return role


def final_state(roles: Column, template: Template) -> Column:
    """State of the machine after all roles; ``error`` once a role may not follow."""

    def step(state: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for before, after in template.order:
            allowed = allowed | ((state == before) & (role == after))
        return F.when(allowed, role).otherwise(F.lit("error"))

    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, n_turns, valid, segments, formatted)``, one row per conversation.

    ``segments`` is an array of ``(text, loss)``: the escaped pieces of ``formatted`` in order, each with
    its loss flag. Only whole conversations meet in a task.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(x: Column) -> Column:
        head = F.concat(F.lit(template.head), _name(x["role"], template), F.lit(template.colon))
        carries = x["role"].isin(*template.loss)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], template).alias("text"), carries.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    made = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        final_state(F.col("turns.role"), template).isin(*template.accept).alias("valid"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_formatted(formatted: Column, template: Template = Template()) -> Column:
    """Turns ``array<struct<role, text>>`` back from formatted text."""
    parts = F.split(formatted, "\\Q" + template.end + "\\E", -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skip = len(template.head) + 1

    def parse(part: Column) -> Column:
        at = F.instr(part, template.colon)
        name = F.substring(part, F.lit(skip), at - F.lit(skip))
        text = F.substring(part, at + F.lit(len(template.colon)), F.lit(1 << 30))
        return F.struct(_role(name, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(turns, parse)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")


CONTROL_TEXT = r"\### Assistant: </turn> ok"  # of the added conversation -7


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back from the output."""
    given = scan(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    made = format_conversations(given.unionByName(added))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = made.select(
        "conv_id",
        read_formatted(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("under"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(bind(F.col("turns"), lambda ts: F.array_join(F.transform(ts, turn), "")), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(length(role) + 14
    + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'))) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(substr(role, 1, 1), '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM rows GROUP BY conv_id
"""
