"""Columns that turn codes into what a reader sees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldmill import constants as K
from fieldmill.functions.common import bind, extract, percent, strip


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, F.coalesce(key, F.lit("")))


def spaced(c: Column) -> Column:
    """`needs_review` -> `needs review`."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def parser_label(parser_type: Column) -> Column:
    return F.coalesce(_lookup(K.PARSER_LABELS, parser_type),
                      F.concat(parser_type, F.lit(" preview")))


def mode_label(mode: Column) -> Column:
    return F.coalesce(_lookup(K.MODE_LABELS, mode), F.when(mode != "", spaced(mode)),
                      F.lit("Unknown"))


def file_label(filename: Column, doc_id: Column) -> Column:
    return F.when(F.coalesce(filename, F.lit("")) != "", filename).otherwise(
        F.concat(F.lit("Raw text document #"), doc_id.cast("string")))


def percent_label(c: Column) -> Column:
    return percent(c)


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.9, "High").when(c >= 0.8, "Medium").otherwise("Low")


def run_provider(reasoning: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(reasoning, F.lit("")), K.RUN_METADATA, 1))


def run_model(reasoning: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(reasoning, F.lit("")), K.RUN_METADATA, 2))


def clean_reason(reasoning: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(reasoning, F.lit("")), K.RUN_PREFIX, ""))


def record_preview(text: Column, limit: int = 51) -> Column:
    """The first non-empty lines, each split at commas and trimmed (array<array<string>>)."""
    lines = F.filter(F.split(strip(text), "\r?\n"), lambda x: x != "")
    return F.transform(F.slice(lines, 1, limit),
                       lambda line: F.transform(F.split(line, ","), lambda cell: strip(cell)))


def pretty_json(text: Column) -> Column:
    """Indented JSON, or the text itself when it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text), {"pretty": "true"}), text)


def source_span(text: Column, start: Column, end: Column, snippet: Column, display: Column,
                extracted: Column) -> Column:
    """struct(matched, start, end, before, hit, after) of a field in its text; without a match all of the text stands in `before`.

    Stored offsets win; else the first of snippet / display / extracted value that is found,
    exactly or with any whitespace where it has whitespace, ignoring case.
    """
    def flexible(needle):
        """Looks for the needle in the text with every run of whitespace as one blank, and takes the place back to the text as it is."""
        def own_place(before):
            # each piece of the text ends with a run of whitespace, which is one blank in `before`
            pieces = F.split(text, r"(?<=\s)(?!\s)")
            runs = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
            return F.length(F.array_join(F.slice(pieces, F.lit(1), runs), "")) + F.length(F.substring_index(before, " ", -1))

        def look(folded):
            at = F.position(F.regexp_replace(F.lower(needle), r"\s+", " "), folded)
            return bind(at, lambda a: F.when(a > 0, bind(F.left(folded, a - 1), own_place)).otherwise(F.lit(-1)))
        return bind(F.regexp_replace(F.lower(text), r"\s+", " "), look)

    def find(needle):
        def hit(v):
            direct = F.position(F.lower(v), F.lower(text)) - 1
            at = bind(direct, lambda d: F.when(d >= 0, d)
                      .when(F.rlike(v, F.lit(r"\s")), flexible(v)).otherwise(F.lit(-1)))
            return F.when(v != "", bind(at, lambda a: F.when(a >= 0, F.struct(
                a.alias("start"), F.least(a + F.length(v), F.length(text)).alias("end")))))
        return bind(strip(F.coalesce(needle, F.lit(""))), hit)

    size = F.length(text)
    low = F.greatest(F.lit(0), F.least(size, start))
    high = F.greatest(low, F.least(size, end))
    stored = F.when(start.isNotNull() & end.isNotNull() & (high > low),
                    F.struct(low.alias("start"), high.alias("end")))
    best = F.coalesce(stored, find(snippet), find(display), find(extracted))
    return bind(best, lambda b: F.struct(
        b.isNotNull().alias("matched"), b["start"].alias("start"), b["end"].alias("end"),
        F.when(b.isNull(), text).otherwise(F.left(text, b["start"])).alias("before"),
        F.when(b.isNull(), "").otherwise(F.substring(text, b["start"] + 1, b["end"] - b["start"])).alias("hit"),
        F.when(b.isNull(), "").otherwise(F.substring(text, b["end"] + 1, F.length(text))).alias("after")))
