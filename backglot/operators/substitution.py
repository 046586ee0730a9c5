"""Line tables, token tables and dictionary substitution.

Two plans give the same document, whatever the table's size. A small dictionary becomes a map literal and the whole
rewrite is one projection without a shuffle. A larger one is a join: each document sends its distinct words, gets the
entries it needs back as one small table, and is rewritten in its row. So no piece of text is shuffled, a word that
fills half of all tokens is one row per document, and a document is lexed twice at most. Rows are told apart by an id
of their own: repeated and null keys are as good as any. Of repeated words in a table the least replacement counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backglot.functions import lexing
from backglot.functions.expr import bind
from backglot.functions.lexing import Lexer
from backglot.operators.lookup import lookup_join
from backglot.sources.tables import hand_over

INLINE_ROWS = 5_000  # larger tables are joined
INLINE_ENTRY_BYTES = 2_048
INLINE_BUCKETS = 1_024

Lookup = Callable[[Column], Column]


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ln, indent, body)``: one row per line, blank lines kept verbatim as indent."""
    exploded = df.select(key, F.posexplode(lexing.lines(F.col(text))).alias("ln", "line"))
    blank = lexing.is_blank(F.col("line"))
    return exploded.select(
        key,
        "ln",
        F.when(blank, F.col("line")).otherwise(lexing.indent(F.col("line"))).alias("indent"),
        F.when(blank, F.lit("")).otherwise(lexing.body(F.col("line"))).alias("body"),
    )


def comment_split(lines: DataFrame) -> DataFrame:
    """Add the code and comment part of each line body."""
    return lines.select(
        "*", lexing.code_part(F.col("body")).alias("code"), lexing.comment_part(F.col("body")).alias("comment")
    )


def token_table(df: DataFrame, key: str, text: str, lexer: Lexer) -> DataFrame:
    """``(key, ln, p, type, value)``: one row per token of the code part of each line."""
    code = comment_split(line_table(df, key, text))
    tokens = code.select(key, "ln", F.posexplode(lexer.tokens(F.col("code"))).alias("p", "value"))
    return tokens.select(key, "ln", "p", lexer.token_type(F.col("value")).alias("type"), "value")


def substitute_tokens(tokens: DataFrame, dictionary: DataFrame, row_id: list[str]) -> DataFrame:
    """Replace word tokens of a token table; all other tokens stay."""
    word = F.when(F.col("type") == "word", F.col("value"))
    joined = lookup_join(tokens.withColumn("word", word), dictionary, "word", row_id)
    return joined.withColumn("value", F.coalesce("repl", "value")).drop("word", "repl")


def inline_lookup(table: DataFrame, rows: int = INLINE_ROWS) -> Lookup | None:
    """A small ``(word, repl)`` table as a literal lookup, or None beyond the bound.

    Map lookups scan their keys, so entries are spread over hash buckets: an array of
    small maps, folded into one literal at planning time. What reaches the driver is
    bounded by ``rows`` and ``INLINE_ENTRY_BYTES``; a table over either bound is joined.
    """
    count = F.lit(INLINE_BUCKETS)
    fits = F.octet_length("word") + F.octet_length("repl") <= INLINE_ENTRY_BYTES
    sized = table.select(
        F.when(fits, F.pmod(F.hash("word"), count)), F.when(fits, F.col("word")), F.when(fits, F.col("repl"))
    )
    entries = sized.limit(rows + 1).collect()
    if len(entries) > rows or any(bucket is None for bucket, _, _ in entries):
        return None
    buckets: list[dict[str, str]] = [{} for _ in range(INLINE_BUCKETS)]
    for bucket, word, repl in entries:
        buckets[bucket][word] = repl
    maps = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return lambda word: F.element_at(F.get(maps, F.pmod(F.hash(word), count)), word)


def one_entry_each(table: DataFrame) -> DataFrame:
    """``(word, repl)`` with one row per word: the least replacement of repeated words."""
    return table.where(F.col("word").isNotNull()).groupBy("word").agg(F.min("repl").alias("repl"))


def usable_entries(dictionary: DataFrame, lexer: Lexer) -> DataFrame:
    """Entries made of word characters: they can only ever match word tokens."""
    return dictionary.where(lexer.is_only_word(F.col("word"))).select("word", "repl")


def _own_lookups(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``(_row, _maps)``: the entries that a row's words ask for, as small maps by hash.

    ``asked`` holds ``(_row, buckets, word)``, and one row without a word for each bucket, so that every bucket is there.
    Buckets are made by grouping, so a row of n distinct words costs n, and each map holds about sixteen of them.
    """
    found = lookup_join(asked, table, "word", ["_row"])
    hit = F.when(F.col("repl").isNotNull(), F.struct("word", "repl"))
    dealt = found.repartition("_row")  # both groupings need no other shuffle
    maps = dealt.groupBy("_row", "bucket").agg(F.map_from_entries(F.collect_list(hit)).alias("entries"))
    listed = maps.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("bucket", F.map_entries("entries").alias("e")))).alias("b"))
    return listed.select("_row", F.transform("b", lambda x: F.map_from_entries(x["e"])).alias("_maps"))


def rewrite_pieces(
    df: DataFrame,
    key: str,
    text: str,
    out: str,
    lexer: Lexer,
    table: DataFrame | Lookup,
    piece_key: Callable[[Column], Column] | None,
    piece_value: Callable[[Column, Column, Column], Column],
    tidy_comments: bool,
    inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Add column ``out``: ``text`` with every piece looked up in ``table(word, repl)``.

    ``table`` may also be the result of :func:`inline_lookup`, to use it several times.

    ``piece_key`` names what to look up for a piece (null for nothing; None: the piece itself), ``piece_value``
    turns piece, key and hit into the new piece.
    """
    pieces = lexing.document_pieces(F.col(text), lexer, tidy_comments)
    if isinstance(table, DataFrame):
        table = hand_over(one_entry_each(table), "entries")  # measured and used several times
        lookup = inline_lookup(table, inline_rows)
    else:
        lookup = table

    def rewrite(look: Lookup) -> Column:
        def piece(p: Column) -> Column:
            if piece_key is None:
                return piece_value(p, p, look(p))
            return bind(piece_key(p), lambda wanted: piece_value(p, wanted, look(wanted)))

        return F.array_join(F.transform(pieces, piece), "")

    if lookup is not None:
        return df.withColumn(out, rewrite(lookup))

    numbered = hand_over(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    wanted = F.transform(pieces, piece_key) if piece_key else pieces
    words = numbered.select("_row", F.array_distinct(F.filter(wanted, lambda w: w.isNotNull())).alias("words"))
    words = words.withColumn("buckets", F.greatest(F.lit(1), F.floor(F.size("words") / 16).cast("int")))
    own = F.transform("words", lambda w: F.struct(F.pmod(F.hash(w), F.col("buckets")).alias("bucket"), w.alias("word")))
    every = F.transform(
        F.sequence(F.lit(0), F.col("buckets") - 1), lambda b: F.struct(b.alias("bucket"), F.lit(None).cast("string").alias("word"))
    )
    asked = words.select("_row", F.inline(F.concat(own, every)))
    joined = numbered.join(_own_lookups(hand_over(asked, "asked"), table), "_row", "left")
    look = lambda word: F.element_at(F.get("_maps", F.pmod(F.hash(word), F.size("_maps"))), word)
    return joined.withColumn(out, rewrite(look)).drop("_row", "_maps")


def substitute_documents(
    df: DataFrame,
    key: str,
    text: str,
    out: str,
    dictionary: DataFrame | Lookup,
    lexer: Lexer,
    inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Partial translation of whole documents: comments tidied, word tokens replaced."""
    usable = usable_entries(dictionary, lexer) if isinstance(dictionary, DataFrame) else dictionary
    return rewrite_pieces(
        df,
        key,
        text,
        out,
        lexer,
        usable,
        piece_key=None,
        piece_value=lambda piece, wanted, hit: F.coalesce(hit, piece),
        tidy_comments=True,
        inline_rows=inline_rows,
    )
