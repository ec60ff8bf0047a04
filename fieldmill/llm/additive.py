"""A quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a fixed list of numbers (FEATURES), worked out over the bytes of many texts at once. Every feature has
bins (quantiles of the sample) and a lookup table with one number per bin. Learning goes round the features in a cycle: each
time a shallow tree (at most four leaves) over the bins of one feature is fitted to the present gradients, and a part of its
leaves is added to the feature's table. Then the pairs of features that explain most of what is left (one cut on each,
over coarse bins) get tables of two dimensions, learned in the same way by trees that cut one feature and then the other on
both sides. The score is the logistic of the sum of the entries that a document's bins name; nothing else is kept, so a
score can be read entry by entry.

The model is learned from a bounded sample: at most about `sample_rows` labelled documents of each class, those with the
smallest hash of doc_id, weighted to the shares the classes have. Everything else covers all documents.

Null, empty and wordless texts: all features 0, scored like others. Null doc_id: scored, never learned from, not held out.
Repeated labels of a doc_id: their mean, a half or more counts as 1. Null labels: none. Repeated doc_ids: each row is scored; for
learning, the row with the smallest features stands for the id. One class only: every score is 1 or 0, as it says; no labels at
all: every score is 0.5. Empty table: no rows. Only doc_id and text of the documents, doc_id and quality of the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import slices, stored
from fieldmill.llm.shingles import BASE, INVERSE, U64, mix, powers
from fieldmill.llm.words import words_of

FEATURES = ["words", "bytes_per_word", "symbol_bytes", "digit_bytes", "upper_letters", "punctuation_bytes", "other_scripts", "calls",
            "words_per_line", "repeated_lines", "ended_lines", "distinct_words", "words_as_before", "commonest_word", "repeated_triples",
            "words_ending_in_symbol", "upper_words", "words_without_letter", "doubled_marks", "longest_word"]
BYTES = np.arange(256)


def holds(chars: str) -> np.ndarray:
    return np.isin(BYTES, list(chars.encode()))


SYMBOLS, DIGITS, MARKS, CALLS, ENDS = holds("#*$%&|<>"), holds("0123456789"), holds(".,;:!?'\"()-"), holds("!?"), holds(".!?:\"')")
UPPER, LOWER, OTHER = (BYTES > 64) & (BYTES < 91), (BYTES > 96) & (BYTES < 123), BYTES > 127
DOUBLED = SYMBOLS | holds("!?.,;:-_=~")


#: Kinds of bytes that tell what a word is made of.
KINDS = UPPER.astype(np.uint8) + LOWER * np.uint8(2) + OTHER * np.uint8(4)


def counted(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often the mask holds between each bound and the next."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), bounds))


def largest(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest of each group of neighbours of these sizes; 0 for empty groups."""
    out = np.zeros(len(sizes), np.int64)
    full = sizes > 0
    if full.any():
        out[full] = np.maximum.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(24)).view(np.int64)


def groups(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, how often) of every distinct (owner, value); values of 40 bits, owners of 23."""
    keys = np.sort((owner << 40) | value)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first] >> 40, np.diff(np.concatenate([first, [len(keys)]]))


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(texts)
    found = words_of(texts)
    raw, ends, starts, stops, bounds = found.raw, found.ends, found.starts, found.stops, found.bounds
    ids = found.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words, size = np.diff(bounds), np.diff(ends)
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    text = np.repeat(np.arange(n), words)
    within = lambda mask: counted(mask, bounds)
    of_text = lambda table: counted(table[raw], ends)
    upper = of_text(UPPER)
    letters = np.maximum(upper + of_text(LOWER), 1)
    length = stops - starts
    kinds = np.bitwise_or.reduceat(KINDS[raw], starts) if len(starts) else np.empty(0, np.uint8)
    last = raw[stops - 1] if len(stops) else np.empty(0, np.uint8)
    doubled = (length > 1) & DOUBLED[last] & (raw[np.maximum(stops - 2, 0)] == last) if len(stops) else np.empty(0, bool)

    # lines: between line feeds and the ends of texts, those with a word
    feeds = np.flatnonzero(raw == 10)
    opens, closes = np.union1d(ends[:-1], feeds + 1), np.union1d(ends[1:], feeds)
    opens, closes = opens[opens < len(raw)], closes[closes > 0]
    word_at = np.searchsorted(starts, opens)
    line_words = np.diff(np.concatenate([word_at, [len(starts)]]))
    full = line_words > 0
    first_word, last_word = word_at[full], word_at[full] + line_words[full] - 1
    line_text = text[first_word]
    lines = np.bincount(line_text, minlength=n)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(ids) + 1, U64)
        hashed = mix(ids.astype(U64) + U64(1))
        np.cumsum(hashed * powers(BASE, len(ids)), out=sums[1:])
        line_hash = short(mix((sums[last_word + 1] - sums[first_word]) * powers(INVERSE, len(ids) + 1)[first_word]))
        triple = short(mix((hashed[:-2] * U64(3) + hashed[1:-1]) * U64(5) + hashed[2:]))
    distinct_lines = np.bincount(groups(line_text, line_hash)[0], minlength=n)
    ended = np.bincount(line_text, weights=ENDS[last[last_word]], minlength=n) if len(line_text) else np.zeros(n)

    word_owner, often = groups(text, ids)
    commonest, longest = largest(often, np.bincount(word_owner, minlength=n)), largest(length, words)
    inside = text[2:] == text[:-2]
    triple_owner, times = groups(text[2:][inside], triple[inside])
    repeated = np.bincount(triple_owner, weights=times * (times > 1), minlength=n)
    as_before = np.zeros(len(ids), bool)
    as_before[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])

    columns = [
        np.log1p(words), np.add.reduceat(np.concatenate([length, [0]]), np.minimum(bounds[:-1], len(length))) * (words > 0) * per_word,
        of_text(SYMBOLS) * per_byte, of_text(DIGITS) * per_byte, upper / letters, of_text(MARKS) * per_byte,
        of_text(OTHER) * per_byte, of_text(CALLS) * per_word, words / np.maximum(lines, 1),
        (lines - distinct_lines) / np.maximum(lines, 1), ended / np.maximum(lines, 1), np.bincount(word_owner, minlength=n) * per_word,
        within(as_before) * per_word, commonest * per_word, repeated * per_word, within(SYMBOLS[last]) * per_word,
        within((kinds & 3 == 1) & (length > 1)) * per_word, within(kinds == 0) * per_word, within(doubled) * per_word, np.log1p(longest)]
    return np.stack(columns, 1).astype(np.float32) if n else np.empty((0, len(FEATURES)), np.float32)


class Model(NamedTuple):
    """base; per feature its edges and its table; pairs: (feature, feature, coarse bin of each bin of both, table)."""
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def terms(self, x: np.ndarray) -> np.ndarray:
        """Per row what each feature, then each pair, adds."""
        at = self.bins(x)
        single = [t[b] for t, b in zip(self.tables, at, strict=True)]
        return np.stack(single + [table[ci[at[i]], cj[at[j]]] for i, j, ci, cj, table in self.pairs], 1)

    def names(self) -> list[str]:
        return FEATURES + [f"{FEATURES[i]} and {FEATURES[j]}" for i, j, *_ in self.pairs]


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gains(g: np.ndarray, h: np.ndarray, least: float, smooth: float) -> np.ndarray:
    """What a cut after each bin but the last gains; g and h along the last axis."""
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    all_g, all_h = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - all_g**2 / (all_h + smooth)
    return np.where((left_h >= least) & (right_h >= least), gain, -np.inf)


def tree(g: np.ndarray, h: np.ndarray, depth: int, least: float, smooth: float) -> np.ndarray:
    """The leaf value of every bin: the bins are cut where it gains most, `depth` times over."""
    if depth and len(g) > 1:
        gain = gains(g, h, least, smooth)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > 0:
            return np.concatenate([tree(part_g, part_h, depth - 1, least, smooth)
                                   for part_g, part_h in ((g[:cut], h[:cut]), (g[cut:], h[cut:]))])
    return np.full(len(g), g.sum() / (h.sum() + smooth))


def pair_tree(g: np.ndarray, h: np.ndarray, least: float, smooth: float) -> tuple[float, np.ndarray]:
    """(gain, leaf values): one cut on one of the two features, then on each side a cut on the other."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + smooth)))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        if a.shape[0] < 2 or a.shape[1] < 2:
            continue
        low_g, low_h = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        sides = (low_g, low_h), (a.sum(0) - low_g, b.sum(0) - low_h)
        outer = gains(a.sum(1), b.sum(1), least, smooth)
        inner = [np.maximum(gains(sg, sh, least, smooth), 0) for sg, sh in sides]
        total = outer + inner[0].max(1) + inner[1].max(1)
        cut = int(total.argmax())
        if total[cut] > best[0]:
            leaves = [tree(sg[cut], sh[cut], 1, least, smooth) for sg, sh in sides]
            values = np.where(np.arange(a.shape[0])[:, None] <= cut, leaves[0][None], leaves[1][None])
            best = (float(total[cut]), values.T if turned else values)
    return best


def coarse(bins: np.ndarray, weight: np.ndarray, n_bins: int, most: int) -> np.ndarray:
    """Per bin one of at most `most` coarser ones of about equal weight."""
    share = np.cumsum(np.bincount(bins, weights=weight, minlength=n_bins))
    place = np.minimum((share - 1e-9) / share[-1] * most, most - 1).astype(np.int64)
    return np.unique(np.maximum(place, 0), return_inverse=True)[1]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int = 64, cycles: int = 120, rate: float = 0.1, n_pairs: int = 8,
        pair_cycles: int = 40, pair_bins: int = 12, least: float = 2.0, smooth: float = 2.0) -> Model:
    """The model of a sample: features x, labels y (0 or 1), weights."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = float((weight * y).sum() / weight.sum())
    if mean in (0.0, 1.0):
        return Model(40.0 if mean else -40.0, edges, tables, [])
    base = float(np.log(mean / (1 - mean)))
    model = Model(base, edges, tables, [])
    at = model.bins(x)
    total = np.full(len(y), base)
    summed = lambda place, values, n: np.bincount(place, weights=values, minlength=n)
    for _ in range(cycles):
        for j, table in enumerate(tables):
            p = logistic(total)
            step = rate * tree(summed(at[j], weight * (y - p), len(table)), summed(at[j], weight * p * (1 - p), len(table)), 2, least, smooth)
            table += step
            total += step[at[j]]

    # the pairs that explain most of what the single features leave
    p = logistic(total)
    g, h = weight * (y - p), weight * p * (1 - p)
    wide = [coarse(at[j], weight, len(t), pair_bins) for j, t in enumerate(tables)]
    cells = [wide[j][at[j]] for j in range(len(tables))]
    widths = [int(w.max()) + 1 for w in wide]
    ranked = []
    for i in range(len(tables)):
        for j in range(i + 1, len(tables)):
            place, n = cells[i] * widths[j] + cells[j], widths[i] * widths[j]
            shape = widths[i], widths[j]
            ranked.append((pair_tree(summed(place, g, n).reshape(shape), summed(place, h, n).reshape(shape), least, smooth)[0], i, j))
    chosen = [(i, j) for gain, i, j in sorted(ranked, key=lambda r: (-r[0], r[1:]))[:n_pairs] if gain > 0]
    pairs = [(i, j, wide[i], wide[j], np.zeros((widths[i], widths[j]))) for i, j in chosen]
    for _ in range(pair_cycles):
        for i, j, _, _, table in pairs:
            p = logistic(total)
            place, n = cells[i] * widths[j] + cells[j], table.size
            step = rate * pair_tree(summed(place, weight * (y - p), n).reshape(table.shape),
                                    summed(place, weight * p * (1 - p), n).reshape(table.shape), least, smooth)[1]
            table += step
            total += step[cells[i], cells[j]]
    return Model(base, edges, tables, pairs)


def described(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, features; written once, as learning and scoring both read it."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                values = features(part.column("text"))
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(describe, "doc_id long, features array<float>"), "additive-features")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def train(described_docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> Model | None:
    """The model learned from rows of labels (doc_id, quality 0 or 1); None without a labelled document.

    At most about sample_rows ids of each class (never more than twice as many) are learned from, chosen by a hash of the id.
    """
    mean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("_m"))
    known = stored(mean.select("doc_id", (F.col("_m") >= 0.5).cast("int").alias("label")), "additive-labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for label, n in counts.items():
        share = min(1.0, sample_rows / n)
        drawn = known.where((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
        parts.append(drawn.limit(2 * sample_rows))
    if not parts:
        return None
    chosen = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    # at most four times sample_rows ids and labels, a few hundred kilobytes
    rows = described_docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("features").alias("features"), F.max("label").alias("label")).toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id").combine_chunks()
    x, y = matrix(rows.column("features").combine_chunks()), rows.column("label").to_numpy()
    drawn = np.bincount(y, minlength=2)
    weight = np.array([counts.get(k, 0) / max(drawn[k], 1) for k in (0, 1)])
    weight *= len(y) / max(weight[y].sum(), 1e-9)
    return fit(x.astype(np.float32), y, weight[y])


def scored(described_docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, score, predicted (1 from 0.5 on), weakest (the term that takes most off the score, null if none does)."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.names(), object) if model else None
        for batch in batches:
            if model is None:
                p, weakest = np.full(batch.num_rows, 0.5), [None] * batch.num_rows
            else:
                terms = model.terms(matrix(batch.column("features")))
                p = logistic(model.base + terms.sum(1))
                least = terms.argmin(1) if len(terms) else np.empty(0, np.int64)
                weakest = np.where(terms[np.arange(len(least)), least] < 0, names[least], None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                                              pa.array(weakest, pa.string())], ["doc_id", "score", "predicted", "weakest"])

    return described_docs.mapInArrow(score, "doc_id long, score double, predicted int, weakest string")
