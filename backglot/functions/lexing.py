"""Line and token expressions: everything that turns a document into pieces, inside one projection.

A document becomes a flat array of *pieces* whose concatenation is the document:
indents, tokens, comments and line breaks. Word tokens are the only pieces made of
word characters, comments the only ones that start with ``#`` and go on, so a piece
needs no separate type tag and a dictionary restricted to word characters can be
applied to all pieces alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from backglot.functions.expr import bind, no_strings
from backglot.functions.languages import word_chars
from backglot.functions.text import rstrip, strip

# Operators of the two lexers, longest first, then single characters.
STAGE0_OPERATORS = ["==", "!=", "<=", ">=", "//", "**"]
STAGE1_OPERATORS = [
    "<<=", ">>=", "...",
    "==", "!=", "<=", ">=", "//", "**",
    "+=", "-=", "*=", "/=", "%=", "&=",
    "|=", "^=", "<<", ">>", "&&", "||",
    "++", "--", "->", "=>", "::",
]
SINGLE_OPERATORS = r"()[]{}+-*/%=<>!&|^~.,;:?@#$" + "\\"

_SPACE = r"[\s\x1c-\x1f]"
_STRING = r"\"(?:\\[^\n]|[^\"\n])*+\"?|'(?:\\[^\n]|[^'\n])*+'?"  # within a line
_COMMENT = r"(?s)^((?:[^\"'#]++|\"[^\"]*+\"|'[^']*+')*+)(#.*)\z"
_RANGES = {"a-z": "abcdefghijklmnopqrstuvwxyz", "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _escape(symbol: str) -> str:
    return "".join("\\" + c for c in symbol)


@dataclass(frozen=True)
class Lexer:
    """Token pattern for a language pair.

    With ``keep_gaps`` characters outside both scripts are pieces of their own, blanks before a comment and comments stay
    as they are, and the pieces of any document joined are the document.
    """

    source: str
    target: str
    operators: tuple[str, ...] = tuple(STAGE0_OPERATORS)
    keep_gaps: bool = False

    @property
    def word_class(self) -> str:
        """Each character once: Java tests single Latin characters in one look, ranges one after the other."""
        listed = word_chars(self.source) + word_chars(self.target)
        for span, letters in _RANGES.items():
            if span in listed:
                listed = listed.replace(span, "") + letters
        return rf"[{listed}\d_]"

    @property
    def pattern(self) -> str:
        """No two kinds of token begin with the same character, so words, the most frequent kind, are tried first."""
        ops = "|".join(_escape(o) for o in self.operators)
        singles = "".join("\\" + c for c in SINGLE_OPERATORS)
        return rf"(?Us){self.word_class}+|{_SPACE}+|{_STRING}|{ops}|[{singles}]" + ("|." if self.keep_gaps else "")

    def tokens(self, code: Column) -> Column:
        """All tokens of code without comments; other characters are dropped, or pieces of their own."""
        return F.regexp_extract_all(code, F.lit(self.pattern), F.lit(0))

    def is_word(self, piece: Column) -> Column:
        return piece.rlike(rf"(?U)^{self.word_class}")

    def is_only_word(self, text: Column) -> Column:
        return text.rlike(rf"(?U)^{self.word_class}+\z")

    def token_type(self, token: Column) -> Column:
        return (
            F.when(token.rlike(rf"(?U)^{_SPACE}"), "space")
            .when(token.rlike("^[\"']"), "string")
            .when(self.is_word(token), "word")
            .otherwise("operator")
        )


def stage0_lexer(source: str, target: str, keep_gaps: bool = False) -> Lexer:
    return Lexer(source, target, keep_gaps=keep_gaps)


def stage1_lexer(source: str, target: str) -> Lexer:
    return Lexer(source, target, tuple(STAGE1_OPERATORS))


def lines(document: Column) -> Column:
    return F.split(document, "\n", -1)


def is_blank(line: Column) -> Column:
    return line.rlike(rf"(?U)^{_SPACE}*\z")


def indent(line: Column) -> Column:
    return F.regexp_extract(line, rf"(?U)^({_SPACE}*)", 1)


def body(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?U)^{_SPACE}+", "")


def code_part(line: Column) -> Column:
    """Code before a comment, right-stripped only when a comment follows."""
    commented = F.contains(line, F.lit("#")) & line.rlike(_COMMENT)
    return F.when(commented, rstrip(F.regexp_extract(line, _COMMENT, 1))).otherwise(line)


def comment_part(line: Column) -> Column:
    """Comment from the first ``#`` outside quotes; empty without one."""
    return F.when(~F.contains(line, F.lit("#")), "").otherwise(F.regexp_extract(line, _COMMENT, 2))


def comment_text(comment: Column) -> Column:
    return strip(F.substring(comment, 2, 1 << 30))


def tidy_comment(comment: Column) -> Column:
    """``#`` directly followed by the stripped text; bare comments stay."""
    return bind(comment_text(comment), lambda text: F.when(text == "", comment).otherwise(F.concat(F.lit("#"), text)))


def _line_pieces(line: Column, lexer: Lexer, tidy: bool) -> Column:
    def whole_body(rest: Column) -> Column:
        comment = F.when(F.contains(rest, F.lit("#")), comment_part(rest)).otherwise(F.lit(""))
        parts = lambda c: F.concat(
            F.array(indent(line)),
            lexer.tokens(F.substring(rest, F.lit(1), F.length(rest) - F.length(c))),
            F.when(c == "", no_strings()).otherwise(F.array(c)),
        )
        return bind(comment, parts)

    def split_body(rest: Column) -> Column:
        comment = comment_part(rest)
        tail = F.when(
            F.contains(rest, F.lit("#")),
            bind(
                comment,
                lambda c: F.when(c == "", no_strings()).otherwise(F.array(F.lit(" "), tidy_comment(c) if tidy else c)),
            ),
        ).otherwise(no_strings())
        code = F.when(F.contains(rest, F.lit("#")), code_part(rest)).otherwise(rest)
        return F.concat(F.array(indent(line)), lexer.tokens(code), tail)

    return F.when(is_blank(line), F.array(line)).otherwise(bind(body(line), whole_body if lexer.keep_gaps else split_body))


def document_pieces(document: Column, lexer: Lexer, tidy_comments: bool = True) -> Column:
    """Flat piece array of a whole document; joined: the normalised document, with ``keep_gaps`` the document itself.

    A document without ``#`` has no comments, and as no token but white space goes over a line's end it is lexed as a whole.
    """

    def with_break(line: Column, index: Column) -> Column:
        pieces = _line_pieces(line, lexer, tidy_comments)
        return F.when(index == 0, pieces).otherwise(F.concat(F.array(F.lit("\n")), pieces))

    by_line = F.flatten(F.transform(lines(document), with_break))
    return F.when(F.contains(document, F.lit("#")), by_line).otherwise(lexer.tokens(document))


def is_comment_piece(piece: Column) -> Column:
    return F.startswith(piece, F.lit("#")) & (F.length(piece) > 1)
