"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Trim all ASCII whitespace, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst may inline an aliased column into a lambda, where it would be recomputed for every
    array element; a lambda variable cannot be inlined. An aggregate over nothing, as a transform copies
    what its body returns, and so all fields of a document once per level.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def strings(values) -> Column:
    """A literal array<string>."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def title(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others."""
    def first_up(p):
        # initcap looks for words by locale, which costs far more than the letters of plain words
        return F.when(F.length(p) == F.octet_length(p), F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))).otherwise(F.initcap(p))
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, first_up), "")


def normalize_key(c: Column) -> Column:
    """Every character that is neither letter nor digit becomes '_'; outer '_' are dropped."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def normalize_label(c: Column) -> Column:
    """Underscores become blanks, runs of whitespace become one blank, lower case."""
    return strip(F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), r"\s+", " "))


def parse_amount(c: Column) -> Column:
    """Number left after dropping every other character, or NULL."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def percent(c: Column) -> Column:
    """0.925 -> '93%' (half up)."""
    return F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))


def extract(text: Column, pattern: Column, group: int) -> Column:
    """regexp_extract with the pattern in a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))
