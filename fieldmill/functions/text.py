"""Text columns -> classes, tokens, snippets, labelled values. No shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from fieldmill import constants as K
from fieldmill.catalogue import MAX_LABEL_WORDS
from fieldmill.functions.common import bind, extract, strip
from fieldmill.schemas import FIELD, field, source_span


def classify(low: Column, parser_type: Column) -> Column:
    """struct(type, confidence, reason) of a lower-case text: by parser, then by first keyword."""
    def answer(kind, confidence, reason):
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"),
                        F.lit(reason).alias("reason"))
    def by_keyword(lower):
        chain = F
        for words, kind, confidence, reason in K.KEYWORD_CLASSES:
            hit = F.lit(False)
            for word in words:
                hit = hit | F.contains(lower, F.lit(word))
            chain = chain.when(hit, answer(kind, confidence, reason))
        return chain.otherwise(answer(*K.DEFAULT_CLASS))
    chain = F
    for parser, kind, confidence, reason in K.PARSER_CLASSES:
        chain = chain.when(parser_type == parser, answer(kind, confidence, reason))
    return chain.otherwise(bind(low, by_keyword))


def summary(text: Column) -> Column:
    """First three non-blank lines joined by a blank, at most 300 characters.

    The anchored pattern reads only the head of the text, whatever its length.
    """
    head = F.regexp_extract(text, r"^\s*([^\r\n]+(?:[\r\n]\s*[^\r\n]+){0,2})", 1)
    lines = F.transform(F.split(head, r"[\r\n]+"), lambda x: strip(x))
    joined = F.left(F.array_join(F.filter(lines, lambda x: x != ""), " "), F.lit(300))
    return F.when(joined == "", F.left(text, F.lit(300))).otherwise(joined)


def first_email(text: Column) -> Column:
    # the plain test for the sign is far cheaper than the pattern and settles most texts
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, K.EMAIL_FIND, 0)).otherwise("")


def first_amount(text: Column) -> Column:
    return F.regexp_extract(text, K.AMOUNT_FIND, 0)


def first_date(text: Column) -> Column:
    return F.regexp_extract(text, K.DATE_FIND, 0)


def first_phone(text: Column) -> Column:
    return F.regexp_extract(text, K.PHONE_FIND, 0)


def snippet(text: Column, value: Column, width: int = 120, low: Column | None = None) -> Column:
    """Text around the first case-insensitive hit of value, else the head of the text. ``low``: lower-case text."""
    def cut(at):
        start = F.greatest(F.lit(0), at - 1 - width // 2)
        end = F.least(F.length(text), at - 1 + F.length(value) + width // 2)
        return F.when(at > 0, strip(F.substring(text, start + 1, end - start))).otherwise(
            F.left(text, F.lit(width)))
    at = F.when(F.coalesce(value, F.lit("")) == "", F.lit(0)).otherwise(
        F.position(F.lower(value), F.lower(text) if low is None else low))
    return bind(at, cut)


def generic_fields(text: Column, parser_type: Column, low: Column | None = None) -> Column:
    """The fields any free text yields, in fixed order, as array<field>. ``low``: lower-case text."""
    def token(name, value, confidence, reason):
        # value is bound once so that its pattern runs once per document
        return bind(value, lambda v: F.when(
            v != "", field(name, v, confidence, snippet(text, v, low=low), reason)))
    kind = classify(F.lower(text) if low is None else low, parser_type)
    head = F.left(text, F.lit(160))
    found = F.array(
        bind(kind, lambda k: field("document_type", k["type"], k["confidence"], head, k["reason"])),
        bind(summary(text), lambda s: field(
            "summary", s, F.when(s != "", 0.70).otherwise(0.40), F.left(s, F.lit(220)),
            K.SUMMARY_REASON)),
        token("email", first_email(text), 0.92, K.EMAIL_REASON),
        token("amount", first_amount(text), 0.84, K.AMOUNT_REASON),
        token("date", first_date(text), 0.80, K.DATE_REASON),
        token("phone_or_reference_number", first_phone(text), 0.66, K.PHONE_REASON),
    )
    nothing = field("needs_manual_review_reason", K.NO_FIELDS_VALUE, 0.48,
                    F.left(text, F.lit(220)), K.NO_FIELDS_REASON)
    kept = F.filter(found, lambda f: f.isNotNull())
    return bind(kept, lambda a: F.when(
        F.size(a) <= 2, F.concat(a, F.array(nothing))).otherwise(a)).cast(f"array<{FIELD}>")


def segments(text: Column) -> Column:
    """Lines with their own line end kept, so that offsets are plain sums of lengths."""
    return F.split(text, r"(?<=\n)|(?<=\r)(?!\n)")


#: Fan-out and number of the levels of sums: 64 ** 5 lines are more than a text can have.
FAN, LEVELS = 64, 4


def sums_before(values: Column, body) -> Column:
    """body(before), where before(i) is the sum of the first i values; values: array<int>, bound once.

    Sums of 64 values, of 64 of these sums and so on; before(i) adds up at most 63 numbers of each level, so all of them together cost
    in proportion to their number.
    """
    def total(part):
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def up(levels):
        if len(levels) <= LEVELS:
            now = levels[-1]
            groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(now) - 1) / FAN), F.lit(0)).cast("int")),
                                 lambda b: total(F.slice(now, b * FAN + 1, F.lit(FAN))))
            return bind(groups, lambda above: up([*levels, above]))

        def before(i):
            parts, at = [], i
            for level in levels:
                start = F.floor(at / FAN).cast("int")
                parts.append(total(F.slice(level, start * FAN + 1, at - start * FAN)))
                at = start
            return sum(parts[1:], parts[0])
        return body(before)
    return bind(values, lambda v: up([v]))


def line_table(text: Column) -> Column:
    """array<struct(line, start, text)> of the non-blank lines, 1-based, start 0-based. Costs in proportion to the lines.

    A line's start is summed from the lengths within its block of 64 lines, whose start comes from sums_before over the blocks.
    """
    def rows(segs, blocks):
        def block(b, before):
            def lines(v):
                def row(s, i):
                    lead = F.length(s) - F.length(F.ltrim(s, F.lit(" \t\n\r\x0b\x0c")))
                    start = v["start"] + F.length(F.array_join(F.slice(v["own"], F.lit(1), i), ""))
                    return F.struct((b * FAN + i + 1).alias("line"), (start + lead).cast("int").alias("start"), strip(s).alias("text"))
                return F.transform(v["own"], row)
            return bind(F.struct(before(b).alias("start"), F.slice(segs, b * FAN + 1, F.lit(FAN)).alias("own")), lines)
        return sums_before(blocks, lambda before: F.filter(
            F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: block(b, before))), lambda r: r["text"] != ""))

    def with_blocks(segs):
        lengths = F.transform(F.sequence(F.lit(0), F.floor((F.size(segs) - 1) / FAN).cast("int")),
                              lambda b: F.length(F.array_join(F.slice(segs, b * FAN + 1, F.lit(FAN)), "")))
        return bind(lengths, lambda blocks: rows(segs, blocks))

    return bind(segments(text), with_blocks)


#: What stands in a line before a label, the label's first word, and what follows a label.
FIRST_WORD = K.LABEL_PREFIX + r"([^\s_\-:=–—]+)"
AFTER_LABEL = "^" + K.LABEL_SEPARATOR + r"(.+?)\s*$"
#: One of them follows every label.
SEPARATORS = [":", "=", "-", "–", "—"]


def words_removed(body: Column, words: Column) -> Column:
    """body without its first words - 1 words and what parts them; every pattern is a literal, compiled once per run."""
    chain = F.when(words == 1, body)
    for n in range(2, MAX_LABEL_WORDS + 1):
        chain = chain.when(words == n, F.regexp_replace(body, rf"^(?:[^\s_\-]+[\s_\-]+){{{n - 1}}}", ""))
    return chain


def labelled_fields(text: Column, template_key: Column, labels: Column, template_fields: Column) -> Column:
    """`Label: value` lines as array<field>, in template order: first line, then longest label.

    ``labels`` and ``template_fields`` come from the catalogue profile of the row's template. A line's first word names the few labels
    it may begin with (a map of the profile); only such lines are looked at again, word by word. Patterns are literals; a column holds
    one only for labels with separators in them.
    """
    def unquote(v):
        return strip(F.btrim(F.btrim(strip(v), F.lit('"')), F.lit("'")))

    def hit(i, line, order, label, raw, start):
        return F.struct(i.alias("i"), (-F.length(label)).alias("n"), order.alias("order"), line.alias("line"), raw.alias("raw"),
                        unquote(raw).alias("value"), start.alias("label"))

    def of_line(seg, i):
        """The labels of a line that its first word may open, as far as they fit."""
        def fit(line, body, x):
            def end(tail):
                rest = F.substring(tail, F.length(x["last"]) + 1, F.length(tail))
                raw = F.regexp_extract(rest, AFTER_LABEL, 1)
                written = F.left(body, F.length(body) - F.length(rest))
                same = normal(written) == x["label"]
                return F.when((raw != "") & same, hit(i, line, x["order"], x["label"], raw, written))
            return bind(words_removed(body, x["words"]), end)

        def fits(line, body, ls):
            # the plain beginning settles most labels without a pattern
            return bind(beginning(normal(body)), lambda low: F.transform(
                F.filter(ls, lambda x: F.startswith(low, beginning(x["label"]))), lambda x: fit(line, body, x)))

        first = F.lower(F.regexp_extract(seg, FIRST_WORD, 1))
        known = F.when(any_of(seg, SEPARATORS), F.try_element_at(labels["by_word"], first))
        return bind(known, lambda ls: F.when(ls.isNotNull(), bind(strip(seg), lambda line: bind(
            F.regexp_replace(line, K.LABEL_PREFIX, ""), lambda body: fits(line, body, ls)))))

    def of_pattern(seg, i):
        def one(x, line):
            raw = extract(line, x["pattern"], 2)
            return F.when(raw != "", hit(i, line, x["order"], x["label"], raw, extract(line, x["pattern"], 1)))
        return bind(strip(seg), lambda line: F.transform(labels["unusual"], lambda x: one(x, line)))

    def made(f, h, segs):
        segment = F.get(segs, h["i"])
        offset = F.length(F.array_join(F.slice(segs, F.lit(1), h["i"]), ""))
        lead = F.length(segment) - F.length(F.ltrim(segment, F.lit(" \t\n\r\x0b\x0c")))
        start = offset + lead + F.length(h["line"]) - F.length(h["raw"])
        base = field(f["key"], h["value"], 0.98, F.left(h["line"], F.lit(500)), F.concat(
            F.lit('Deterministically extracted from labelled source line using template '
                  'label/alias "'), strip(normal(h["label"])), F.lit('".')), True,
            source_span(line=h["i"] + 1, start=start, end=start + F.length(h["value"])))
        return with_template(base, f, template_key)

    def chosen(segs, hits):
        """Per field the longest label of its first line with a value."""
        def of_field(f):
            own = F.sort_array(F.filter(hits, lambda h: h["order"] == f["order"]))
            longest = lambda xs: F.filter(xs, lambda h, k: ((k == 0) | (F.get(xs, k - 1)["i"] != h["i"])) & (h["value"] != ""))
            return bind(bind(own, lambda xs: F.get(longest(xs), F.lit(0))), lambda h: F.when(h.isNotNull(), made(f, h, segs)))
        return F.when(F.size(hits) > 0, F.filter(F.transform(template_fields, of_field), lambda x: x.isNotNull()))

    def search(segs):
        found = F.flatten(F.array_compact(F.transform(segs, of_line)))
        unusual = F.when(F.size(labels["unusual"]) > 0, F.flatten(F.transform(segs, of_pattern)))
        hits = F.array_compact(F.when(unusual.isNull(), found).otherwise(F.concat(found, unusual)))
        return bind(hits, lambda hs: chosen(segs, hs))

    empty = F.array().cast(f"array<{FIELD}>")
    return F.coalesce(F.when(labels.isNotNull(), bind(segments(text), search)).cast(f"array<{FIELD}>"), empty)


def any_of(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in signs])


def beginning(low: Column) -> Column:
    """Lower-case text to compare with the beginning of another: a sigma's form depends on what follows it."""
    return F.replace(low, F.lit("ς"), F.lit("σ"))


def normal(label: Column) -> Column:
    """A written label in lower case, its blanks, '_' and '-' as one blank."""
    return F.regexp_replace(F.lower(label), r"[\s_\-]+", " ")


def with_template(item: Column, f: Column, template_key: Column, name: Column | None = None) -> Column:
    """The field struct with the template columns of template field ``f``, and another name if one is given."""
    return F.struct(
        (item["field_name"] if name is None else name).alias("field_name"),
        *[item[c].alias(c) for c in ("value", "confidence", "snippet", "reasoning", "auto_accept")],
        f["key"].alias("standard_field_key"), template_key.alias("template_key"),
        f["data_type"].alias("data_type"), f["required"].alias("required"),
        f["rules"].alias("rules"), item["source"].alias("source"))
