"""Line-first cleaning with DataFrame functions only.

Every line with a word is held against three kinds of rules; lines that break one are removed, then documents that lost
too much of their text are rejected:

* punctuation: a line of several words ends like a sentence; not most of its words end in doubled marks; marks that
  belong to markup are few;
* navigation: separators such as | or » between its words, or nothing but a call such as "read more";
* boilerplate: phrases of cookie banners, legal footers and script notices.

A rule decides by what it finds in relation to the whole line, so that a long line is not lost for its missing last stop or for one
mention of a phrase: a sentence end anywhere in the line is enough, in any of the scripts of SENTENCE_MARKS, and boilerplate phrases
fail a line only where they are at least a tenth of its words.

Null text: no words, so base_failed. Repeated rows give repeated results. Empty table: no rows. All of it happens inside
the row: no shuffle, memory in proportion to the longest text.

n_repeat_words compares 3-word windows by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE = "[ \\t\\n\\x0B\\f\\r]"
SYMBOL = "[#*$%&|<>]"
#: What a line may end with, as in published web-corpus rules, and phrases of page furniture.
ENDS_SENTENCE = "[.!?:;…。！？][\"'’”»)\\]]*\\z"
#: Marks that end a sentence anywhere in a line: those written before a blank, and those of scripts that need none after them.
SENTENCE_MARKS = "[.!?…؟۔։።][\"'’”»)\\]]*([ \\t\\x0B\\f\\r]|\\z)|[。！？｡．।॥]"
BOILERPLATE_SHARE = 10
DOUBLED_MARKS = "[!?]{2,}(?= |$)"
SEPARATORS = "(?<![^ ])[|»›•·>](?![^ ])"
CALLS = ("home", "menu", "search", "read more", "click here", "log in", "login", "sign in", "sign up", "subscribe", "share",
         "share this", "next", "previous", "back to top", "skip to content", "skip to main content", "follow us")
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
               "uses cookies", "enable javascript", "lorem ipsum", "click here to", "subscribe to our")


def words_in(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def line_passes(line: Column) -> Column:
    """Whether a line keeps all rules: fields bare (trimmed, with a word), low (lower case), n (words)."""
    bare, low, n = line["bare"], line["low"], line["n"]
    marks, doubled, separators = (F.size(F.split(bare, p)) - 1 for p in (SYMBOL, DOUBLED_MARKS, SEPARATORS))
    ended = bare.rlike(ENDS_SENTENCE) | bare.rlike(SENTENCE_MARKS)
    punctuation = (ended | (n < 3)) & (doubled * 3 <= n) & (marks * 10 <= F.length(bare))
    navigation = (separators * 8 > n) | F.rtrim(low, F.lit(" .!>»")).isin(*CALLS)
    mentioned = reduce(or_, [F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE])
    held = reduce(add, [(F.size(F.split(low, phrase)) - 1) * (phrase.count(" ") + 1) for phrase in BOILERPLATE])
    return punctuation & ~navigation & ~(mentioned & (held * BOILERPLATE_SHARE >= n))


def line_first(docs: DataFrame, carry: list[str] | None = None, min_words: int = 50, max_repeat_percent: int = 50, min_kept_percent: int = 50) -> DataFrame:
    """_row (struct of the columns in `carry`, doc_id if None), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_chars, kept_chars, cleaned.

    cleaned: the lines that pass, and lines without a word, in their order. kept: not base_failed, and the passing lines
    hold at least min_kept_percent of the characters of all lines (line_chars; both without white space at the ends).
    """
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    rows = docs.select(row.alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.select("_row", "_text", words_in(F.col("_text")).alias("_words"), F.transform(
        F.split("_text", "\n", -1), lambda line: F.struct(line.alias("line"), F.btrim(line, F.lit(SPACES)).alias("bare"))).alias("_lines"))
    word, nothing = F.col("_words"), F.array().cast("array<bigint>")
    window = F.when(F.size(word) < 3, nothing).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))))
    rows = rows.select("_row", "_text", "_lines", F.size(word).cast("long").alias("n_words"),
                       F.length(F.array_join(word, "")).cast("long").alias("word_chars"), window.alias("_hashes"))
    # windows in the order of their hashes; those equal to a neighbour stand twice or more
    rows = rows.withColumn("_sorted", F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    at = F.col("_sorted")
    same = lambda x, k: F.coalesce(x["h"] == F.get(at, k)["h"], F.lit(False))
    found = F.transform(at, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    rows = rows.drop("_hashes").withColumn("_repeated", F.sort_array(F.array_compact(found)))
    rep = F.col("_repeated")
    covered = F.aggregate(F.transform(rep, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(rep, k + 1) - x, F.lit(3)))),
                          F.lit(0), lambda total, x: total + x)
    worded = F.transform(F.filter("_lines", lambda x: x["bare"] != ""), lambda x: x["line"])
    rows = rows.select("_row", "_text", "_lines", "n_words", "word_chars", covered.cast("long").alias("n_repeat_words"),
                       worded.alias("_worded"))
    full = F.transform("_lines", lambda x: F.struct(
        x["line"].alias("line"), x["bare"].alias("bare"), F.lower(x["bare"]).alias("low"),
        F.size(F.split(x["bare"], SPACE)).alias("n")))
    rows = rows.select(
        "_row", "_lines", "n_words", "word_chars", (F.size(F.split("_text", SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.filter(full, lambda x: (x["bare"] == "") | line_passes(x)).alias("_passed"))
    chars = lambda lines: F.length(F.array_join(F.transform(lines, lambda x: x["bare"]), "")).cast("long")
    rows = rows.select("*", chars("_lines").alias("line_chars"), chars("_passed").alias("kept_chars"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed & (100 * F.col("kept_chars") >= min_kept_percent * F.col("line_chars"))
    return rows.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), kept.alias("kept"), "line_chars", "kept_chars",
                       F.array_join(F.transform("_passed", lambda x: x["line"]), "\n").alias("cleaned"))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their cleaned text (and its length in n_chars, where there is one); same columns."""
    done = line_first(docs, docs.columns)
    now = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    row = F.struct(*[now.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
    # a generator, not a filter: a filter would be pushed down with every expression above copied into it
    return done.select(F.inline(F.when(F.col("kept"), F.array(row)).otherwise(F.array().cast(f"array<{docs.schema.simpleString()}>"))))
