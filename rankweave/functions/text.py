"""Analyzers and mark-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANALYZERS = ("unicode", "whitespace", "words")

# The token classes of the analyzers.
LETTERS_OR_DIGITS = r"[\p{L}\p{N}]+"
UNICODE_TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
WORD_CHUNK = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def unicode_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; every Han character on its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(UNICODE_TOKEN), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def word_chunks(text: Column) -> Column:
    """Lower-cased runs, with Han runs kept whole for segmentation."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CHUNK), F.lit(0))


def tokens_of(text: Column, analyzer: str) -> Column:
    """Token array of ``text`` for the analyzers that need no dictionary."""
    if analyzer == "unicode":
        return unicode_tokens(text)
    if analyzer == "whitespace":
        return whitespace_tokens(text)
    raise ValueError(f"no column expression for analyzer {analyzer!r}")


def group_tokens(tokens: Column) -> Column:
    """``array<struct<term, pos>>`` sorted by term, then position."""
    return F.sort_array(
        F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    )


def token_pattern(terms: list[str]) -> str:
    """A pattern for the terms as whole tokens; Han terms need no word edges."""
    alternatives = []
    for term in sorted(set(terms), key=lambda t: (-len(t), t)):
        quoted = "".join(c if c.isalnum() else "\\" + c for c in term)
        if all("㐀" <= c <= "鿿" for c in term):
            alternatives.append(quoted)
        else:
            alternatives.append(
                r"(?<![\p{L}\p{N}&&[^\p{IsHan}]])" + quoted + r"(?![\p{L}\p{N}&&[^\p{IsHan}]])"
            )
    return "(?iu)(" + "|".join(alternatives) + ")"


def literal_replacement(text: str) -> str:
    """``text`` as a regular expression's replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def highlight(text: Column, terms: list[str], begin: str = "<mark>", end: str = "</mark>") -> Column:
    """Wrap every whole token of ``text`` that is one of ``terms`` in the two tags."""
    if not terms:
        return text
    return F.regexp_replace(text, token_pattern(terms), "$1".join(map(literal_replacement, (begin, end))))


def split_bytes(term: Column, max_bytes: int) -> Column:
    """Pieces of at most ``max_bytes`` bytes, never inside a character.

    Plain ASCII is cut by position. Other text is folded character by character,
    a piece being closed when the next character would not fit.
    """
    ascii_cut = F.transform(
        F.sequence(F.lit(1), F.length(term), F.lit(max_bytes)),
        lambda at: F.substring(term, at, F.lit(max_bytes)),
    )
    chars = F.filter(F.split(term, ""), lambda c: c != "")
    folded = F.aggregate(
        chars,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda acc, c: F.when(
            F.octet_length(acc["open"]) + F.octet_length(c) <= max_bytes,
            F.struct(acc["done"].alias("done"), F.concat(acc["open"], c).alias("open")),
        ).otherwise(
            F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), c.alias("open"))
        ),
        lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda p: p != ""),
    )
    return (
        F.when(F.octet_length(term) <= max_bytes, F.array(term))
        .when(F.octet_length(term) == F.length(term), ascii_cut)
        .otherwise(folded)
    )
