"""License scan by a positional rare-token index, with DataFrame functions only.

Templates are short license texts, each with phrases it must hold. The index has, per template, its `rare` words of highest
IDF (document frequencies of the licence words over all documents) with their positions. A file's words that stand in the
index are looked up; template and relative position (place in the file less place in the template) must agree for most of
the template's rare words; then the mandatory phrases are looked for where the template lies. The label's score is the
share of the template's words that stand at their places.

Base phrases are counted by themselves, wherever their words stand consecutively.

Null or empty text: no words, labels are the empty string, places null, score 0. A file may hold any number of templates,
any number of times. Only the counts of the licence words (bounded by the templates) go through the driver; everything
else happens inside the row. Memory is in proportion to the longest text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever they stand.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, words of a public license's notice, phrases that must stand in it.
TEMPLATES = (
    ("agpl", "gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that",
     ("redistribution and use", "source and binary forms")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee")),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit-notice", "released under the mit license", ("under the mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", ("permission is hereby granted", "free of charge")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
RARE_WORDS = 4


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else: Spark's lower() where the text is ASCII, else letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return F.array_remove(F.split(lowered(text), SEPARATOR), "")


def licence_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(documents, documents with each licence word) over all rows of words (words)."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))
    rows = words.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def rare_index(n: int, counts: dict[str, int], templates=TEMPLATES, rare: int = RARE_WORDS) -> dict[str, list[tuple[int, int]]]:
    """word: postings (template number, position), for each template's `rare` words of highest IDF (each at its first place)."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(templates):
        words = text.split()
        first = {w: words.index(w) for w in reversed(words)}
        idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in first}
        for word in sorted(first, key=lambda w: (-idf[w], w))[:rare]:
            index.setdefault(word, []).append((t, first[word]))
    return index


def places_of(padded: Column, n_words: Column, phrase: str) -> Column:
    """(n, first, last): how often the phrase stands in the words (padded: joined, with a blank at each end), and where."""
    size = len(phrase.split())
    parts = F.split(padded, f" {re.escape(phrase)}(?= )", -1)
    blanks = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    n = F.size(parts) - 1
    first = blanks(F.element_at(parts, 1))
    last = n_words - (blanks(F.element_at(parts, -1)) - 1) - size
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), F.struct(n.alias("n"), first.alias("first"), last.alias("last")))


def scan(docs: DataFrame, templates=TEMPLATES, base: dict[str, str] = BASE, rare: int = RARE_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (template label, first word, words, score)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    n, counts = frequencies(rows.select("words"), licence_words(templates))
    index = rare_index(n, counts, templates, rare)
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", padded.alias("_padded"))

    # base phrases
    found = [places_of(F.col("_padded"), F.col("n_words"), phrase) for phrase in base]
    rows = rows.select("doc_id", "n_words", "words", F.array(*found).alias("_base"))
    labelled = F.array_compact(F.array(*[F.when(F.col("_base")[i].isNotNull(), F.lit(label)) for i, label in enumerate(base.values())]))
    held = F.array_compact("_base")
    rows = rows.select(
        "doc_id", "n_words", "words", labelled.alias("_base_labels"),
        F.aggregate(held, F.lit(0).cast("long"), lambda total, x: total + x["n"]).alias("n_base"),
        F.array_min(F.transform(held, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(held, lambda x: x["last"])).cast("long").alias("last_word"))

    # rare words with their places, then what their postings say: (template, where it would begin)
    posting = "array<struct<t:int,at:int>>"
    by_word = sorted(index)
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*by_word))
    postings = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in index[w]]).cast(posting) for w in by_word])
    place = F.array(*map(F.lit, by_word))
    votes = F.flatten(F.transform(hits, lambda x: F.transform(
        F.element_at(postings, F.array_position(place, x["w"]).cast("int")),
        lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("start")))))
    rows = rows.withColumn("_votes", F.sort_array(votes))
    texts = [text.split() for _, text, _ in templates]
    wanted = [-(-3 * sum(t == k for own in index.values() for t, _ in own) // 4) for k in range(len(templates))]
    need = F.array(*map(F.lit, wanted))
    v = F.col("_votes")
    # in sorted order, the first of a run of at least as many equal votes as the template needs
    agreed = F.filter(F.transform(v, lambda x, k: F.when(
        (F.coalesce(F.get(v, k - 1) != x, F.lit(True))) & (F.get(v, k + F.element_at(need, x["t"] + 1) - 1) == x)
        & (x["start"] >= 0), x)), lambda x: x.isNotNull())
    rows = rows.withColumn("_agreed", agreed)
    all_words = F.array(*[F.array(*map(F.lit, text)) for text in texts])
    phrases = F.array(*[F.array(*[F.lit(f" {p} ") for p in must]) for _, _, must in templates])
    names = F.array(*[F.lit(name) for name, _, _ in templates])

    def spanned(x: Column) -> Column:
        own = F.element_at(all_words, x["t"] + 1)
        stands = F.slice(F.col("words"), x["start"] + 1, F.size(own))
        equal = F.aggregate(F.zip_with(own, stands, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda s, e: s + e)
        return F.struct(F.element_at(names, x["t"] + 1).alias("label"), x["start"].cast("long").alias("first"),
                        F.size(stands).cast("long").alias("n"), (equal / F.size(own)).alias("score"),
                        F.concat(F.lit(" "), F.array_join(stands, " "), F.lit(" ")).alias("stands"),
                        F.element_at(phrases, x["t"] + 1).alias("must"))

    rows = rows.withColumn("_spans", F.transform("_agreed", spanned))
    verified = F.filter("_spans", lambda x: F.forall(x["must"], lambda p: F.contains(x["stands"], p)))
    spans = F.transform(verified, lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first"), x["n"].alias("n"), x["score"].alias("score")))
    rows = rows.withColumn("spans", spans)
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base_labels")).alias("base_labels"),
        joined(F.concat("_base_labels", F.transform("spans", lambda x: x["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "spans")
