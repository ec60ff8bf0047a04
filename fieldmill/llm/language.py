"""Language of whole texts by prediction by partial matching.

Per language a context tree of bytes up to ORDER long is counted on training texts and then frozen. A byte seen after its
context costs -log2(count / (n + d)) bits there; else it costs the escape -log2(d / (n + d)) and what it costs one order
lower; a context never seen costs nothing and passes on; below order 0 a byte costs 8 bits (n: bytes seen after the
context, d: different ones). The language with the shortest code wins. Texts are lower-cased first.

The trees of all languages are one table per order: hash of the byte string to the code length in every language with all
escapes already added, so almost every byte is one lookup.

Training: a sample, bounded per language by `sample_rows` texts and `sample_bytes` bytes in order of a hash of doc_id;
texts over a tenth of sample_bytes are not sampled. The model's size follows from these bounds, not from the corpus.

Null text, or no letter: `und` with score 0. No training text: everything is `und`. Ties go to the smaller name. Rows with
null doc_id are predicted, never learned from. Null lang is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import slices

ORDER = 4
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 1_500_000
UNKNOWN = "und"
#: Bits a byte beyond which a text is in none of the languages; their own texts take 2 to 4, random letters over 7.
MOST_BITS = 6.5
PREDICTED = "doc_id long, lang_pred string, score double, bits_per_byte double"


class ByteTable:
    """Byte strings of one length (as integers) to a row of numbers; open addressing in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.values = values
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            cell, first = np.unique(at, return_index=True)
            first = first[self.keys[cell] == -1]
            self.keys[at[first]], self.rows[at[first]] = keys[todo[first]], todo[first]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; -1 where it isn't held."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.rows[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], at[on]
        return out


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes that end at each place, as one integer (places before size - 1 hold less)."""
    out = np.zeros(len(raw), np.int64)
    for k in range(size):
        out[k:] += raw[:max(0, len(raw) - k)].astype(np.int64) << (8 * k)
    return out


@dataclass
class PpmModel:
    languages: list[str]
    costs: list  # by order: ByteTable of strings of order + 1 bytes, bits in each language
    escapes: list  # by order: ByteTable of contexts, escape bits in each language

    @classmethod
    def train(cls, samples: dict[str, list[bytes]], order: int = ORDER) -> PpmModel:
        languages = sorted(samples)
        if not languages:
            return cls([], [], [])
        counted = []  # by order, by language: (strings, counts)
        for k in range(order + 1):
            of = []
            for language in languages:
                own = [grams(np.frombuffer(t, np.uint8), k + 1)[k:] for t in samples[language]]
                of.append(np.unique(np.concatenate(own) if own else np.empty(0, np.int64), return_counts=True))
            counted.append(of)
        costs, escapes = [], []
        for k in range(order + 1):
            strings = np.unique(np.concatenate([s for s, _ in counted[k]]))
            if k:
                lower = costs[-1].values[costs[-1].find(strings & ((1 << 8 * k) - 1))]
            else:
                lower = np.full((len(strings), len(languages)), 8.0, np.float32)
            contexts = np.unique(strings >> 8)
            bits, escape = lower.copy(), np.zeros((len(contexts), len(languages)), np.float32)
            for j, (own, n) in enumerate(counted[k]):
                if not len(own):
                    continue
                seen, at = np.unique(own >> 8, return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                escape[np.searchsorted(contexts, seen), j] = -np.log2(kinds / (total + kinds))
                bits[:, j] += escape[np.searchsorted(contexts, strings >> 8), j]
                bits[np.searchsorted(strings, own), j] = -np.log2(n / (total + kinds)[at])
            costs.append(ByteTable(strings, bits))
            escapes.append(ByteTable(contexts, escape))
        return cls(languages, costs, escapes)

    def code_lengths(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; the texts stand in `raw` one after the other, ends[i] where the i-th ends."""
        n, top = len(raw), len(self.costs) - 1
        ends = np.asarray(ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        depth = np.full(n, top, np.int64)  # the longest context that lies inside the text
        for k in range(top):
            at = starts + k
            depth[at[at < ends]] = k
        whole = grams(raw, top + 1)
        bits = np.zeros((n, len(self.languages)), np.float32)
        open_at = np.empty(0, np.int64)
        for k in range(top, -1, -1):
            open_at = np.concatenate([open_at, np.flatnonzero(depth == k)])
            if not len(open_at):
                continue
            strings = whole[open_at] & ((1 << 8 * (k + 1)) - 1)
            row = self.costs[k].find(strings)
            hit = row >= 0
            bits[open_at[hit]] += self.costs[k].values[row[hit]]
            open_at, strings = open_at[~hit], strings[~hit]
            row = self.escapes[k].find(strings >> 8)
            known = row >= 0
            bits[open_at[known]] += self.escapes[k].values[row[known]]
        bits[open_at] += 8.0
        full = ends > starts
        out = np.zeros((len(ends), len(self.languages)))
        if full.any():
            out[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.float64)
        return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the doc_id's decimal text leaves 1 when divided by 3; false without doc_id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> PpmModel:
    """Learns from rows with text and lang that are not held out. The choice is made on (id, lang, size) alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text"))
    usable = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    narrow = usable.select("doc_id", "lang", F.octet_length("text").alias("_size"), F.xxhash64("doc_id").alias("_turn"))
    narrow = narrow.where((F.col("_size") > 0) & (F.col("_size") <= max(1, sample_bytes // 10)))
    turn = Window.partitionBy("lang").orderBy("_turn", "doc_id")
    first = narrow.withColumn("_rank", F.row_number().over(turn)).where(F.col("_rank") <= sample_rows)
    first = first.withColumn("_sum", F.sum("_size").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = first.where(F.col("_sum") <= sample_bytes).select("doc_id", "lang").distinct()
    picked = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    samples: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for row in picked.toLocalIterator():
        text = row["text"].lower().encode()
        if held.get(row["lang"], 0) + len(text) <= 2 * sample_bytes:  # repeated doc_ids
            samples.setdefault(row["lang"], []).append(text)
            held[row["lang"]] = held.get(row["lang"], 0) + len(text)
    return PpmModel.train(samples)


def judged(part: pa.RecordBatch, ppm: PpmModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lang_pred, score, bits per byte) of the texts of a batch."""
    names = np.array([*ppm.languages, UNKNOWN], object)
    text = pc.utf8_lower(part.column("text").fill_null("")).cast(pa.large_string())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    best = np.full(len(text), len(ppm.languages))
    score, rate = np.zeros(len(text)), np.zeros(len(text))
    if ppm.languages and letters.any():
        bits = ppm.code_lengths(raw, ends[1:] - ends[0])
        least = bits.min(1)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        best = np.where(letters, bits.argmin(1), best)
        score = np.where(letters, share, 0.0)
        rate = np.where(letters, least / np.maximum(1, np.diff(ends)), 0.0)
    return names[best], score, rate


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, lang_pred, score (share of the winner among all languages), bits_per_byte of its code."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                name, score, rate = judged(part, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(rate)],
                    ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def recognised(docs: DataFrame, model: PpmModel, most_bits: float = MOST_BITS) -> DataFrame:
    """The documents in one of the model's languages, all columns as they are: not `und`, and a code of most_bits a byte at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                name, _, rate = judged(part, shared.value)
                yield part.filter(pa.array((name != UNKNOWN) & (rate <= most_bits)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns on the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score, bits_per_byte."""
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
