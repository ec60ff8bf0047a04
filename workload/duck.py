"""Pieces of DuckDB SQL the checks are put together from."""

from __future__ import annotations

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from workload.registry import q

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def blank(x: str) -> str:
    return f"({strip('coalesce(' + x + ', ' + q('') + ')')} = '')"


def lines(x: str) -> str:
    """Trimmed non-blank lines."""
    return (f"list_filter(list_transform(string_split_regex({x}, '\\r\\n|\\n|\\r'), "
            f"lambda l: {strip('l')}), lambda l: l <> '')")


def find(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def label_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_')"


def amount(x: str) -> str:
    return f"try_cast(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def mean_units(x: str, places: int) -> str:
    """Half-up average in units of the last place, in whole numbers."""
    unit = f"(count({x}) * {10 ** (6 - places)})"
    return f"((2 * CAST(sum(CAST(round({x} * 1000000) AS BIGINT)) AS BIGINT) + {unit}) // (2 * {unit}))"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), "
            "lambda p: upper(p[1]) || p[2:]), '')")


def is_date(x: str) -> str:
    forms = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d/%m/%y", "%d-%m-%y"]
    shapes = ["[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
              "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}"]
    return "(" + " OR ".join(
        f"(regexp_full_match({x}, {q(s)}) AND try_strptime({x}, {q(f)}) IS NOT NULL)"
        for f, s in zip(forms, shapes)) + ")"


def snippet(text: str, value: str) -> str:
    at = f"strpos(lower({text}), lower({value}))"
    start = f"greatest(0, {at} - 61)"
    end = f"least(length({text}), {at} - 1 + length({value}) + 60)"
    return (f"CASE WHEN {value} <> '' AND {at} > 0 THEN {strip(f'substr({text}, {start} + 1, {end} - {start})')} "
            f"ELSE left({text}, 120) END")


def classify(low: str, parser: str, part: int) -> str:
    """part 0: type, 1: confidence, 2: reason."""
    out = "CASE "
    for p in K.PARSER_CLASSES:
        out += f"WHEN {parser} = {q(p[0])} THEN {literal(p[part + 1])} "
    for words, *answer in K.KEYWORD_CLASSES:
        hit = " OR ".join(f"contains({low}, {q(w)})" for w in words)
        out += f"WHEN {hit} THEN {literal(answer[part])} "
    return out + f"ELSE {literal(K.DEFAULT_CLASS[part])} END"


def literal(x) -> str:
    return q(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


def summary(text: str) -> str:
    return (f"coalesce(nullif(left(array_to_string(({lines(text)})[1:3], ' '), 300), ''), left({text}, 300))")


def template_fields() -> str:
    """Catalogue rows: template, torder, tname, forder, fkey, label, dtype, req, synonym list, label list."""
    rows = []
    for i, t in enumerate(Catalogue.bundled().templates):
        for j, f in enumerate(t.fields):
            listed = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
            rows.append(f"({q(t.key)}, {i}, {q(t.name)}, {j}, {q(f.key)}, {q(f.label)}, {q(f.data_type)}, "
                        f"{str(f.required).lower()}, {listed([f.key, f.label, *f.aliases])})")
    synonyms = f"list_distinct(list_transform(names, lambda x: {label_key('x')}))"
    labels = ("list_filter(list_distinct(list_transform(names, lambda x: trim(regexp_replace(lower(replace(x, '_', ' ')), "
              "'[[:space:]]+', ' ', 'g')))), lambda x: x <> '')")
    return (f"(SELECT * EXCLUDE (names), {synonyms} AS synonyms, {labels} AS labels FROM (VALUES " + ", ".join(rows) +
            ") v(template, torder, tname, forder, fkey, label, dtype, req, names))")


def template_terms() -> str:
    rows = [f"({q(t.key)}, {i}, {q(x)})" for i, t in enumerate(Catalogue.bundled().templates) for x in t.terms()]
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") v(template, torder, term))"


def inferred(texts: str) -> str:
    """(doc_id, template, score) of the best template with at least two hits; text must be lower."""
    return f"""(SELECT doc_id, arg_max(template, score * 1000 - torder) AS template,
      max(score) AS score FROM (SELECT doc_id, template, torder, count(*) AS score
        FROM {texts} d JOIN {template_terms()} t ON contains(d.low, t.term) GROUP BY ALL)
      GROUP BY doc_id HAVING max(score) >= 2)"""


def candidates(name: str) -> str:
    whole = label_key(name)
    return (f"[{whole}, CASE WHEN contains({name}, '.') THEN "
            f"{label_key(f'list_last(string_split({name}, {q(chr(46))}))')} END, "
            f"nullif(regexp_extract({whole}, '^records_[0-9]+_(.*)$', 1), '')]")


def labelled(texts: str) -> str:
    """Labelled values of (doc_id, template, text): first line, then longest label.

    Written as a join of every line with every label, unlike the engine's single pass.
    """
    unquoted = strip("trim(trim(" + strip("raw") + ", '\"'), chr(39))")
    label_rows = f"""(SELECT template, fkey, forder, dtype, req, label, array_to_string(list_transform(
        string_split(label, ' '), lambda w: regexp_escape(w)), '[\\s_\\-]+') AS pat
      FROM (SELECT template, fkey, forder, dtype, req, unnest(labels) AS label FROM {template_fields()} x) y)"""
    return f"""(
  SELECT doc_id, template, fkey, forder, dtype, req, value, line_no, line, start_char,
         start_char + length(value) AS end_char, label FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, fkey ORDER BY line_no, length(label) DESC) AS rn FROM (
      SELECT doc_id, template, fkey, forder, dtype, req, label, line_no, line,
        line_start + length(line) - length(raw) AS start_char, {unquoted} AS value FROM (
          SELECT l.doc_id, l.template, l.line_no, l.line, l.start_char AS line_start, f.fkey, f.forder, f.dtype,
            f.req, f.label,
            regexp_extract(l.line, '(?i){K.LABEL_PREFIX}' || f.pat || '{K.LABEL_SEPARATOR}(.+?)\\s*$', 1) AS raw
          FROM {line_rows(texts)} l JOIN {label_rows} f ON l.template = f.template
            AND contains(lower(l.line), string_split(f.label, ' ')[1])) m
      WHERE raw <> '') v WHERE value <> '') o WHERE rn = 1)"""


def line_rows(texts: str) -> str:
    """(doc_id, template, line_no, start_char, line) of the non-blank lines of (doc_id, template, text)."""
    return f"""(SELECT doc_id, template, line_no, before + length(seg) - length(ltrim(seg, {SPACE})) AS start_char,
      {strip('seg')} AS line FROM (
      SELECT doc_id, template, line_no, seg,
        coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT doc_id, template, unnest(segs) AS seg, generate_subscripts(segs, 1) AS line_no
        FROM (SELECT doc_id, template, regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+') AS segs
              FROM {texts} d) s) r) b WHERE {strip('seg')} <> '')"""
