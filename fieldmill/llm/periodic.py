"""Periodic runs of words: stretches that repeat themselves at least three times.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(min_words, 3 * q) words, that no neighbouring word extends. All runs of every whole text are found:

* Periods up to SHORT: the text is compared with itself at each lag, and stretches of equal words are read off.
* Longer periods, by scales lo..hi with hi about 1.5 * lo: the hash of the `hi` words from each place on, and of each
  window of 2 * lo - hi + 1 places those with the smallest hash (all of them, if equal). Inside a run of period q in
  lo..hi both a window and the same window one period later fit, since the run has 3 * q words; so its smallest place
  comes again exactly q later, and as `hi` >= q words name their place in the period, nothing equal comes in between. So each
  place is paired with the next one of equal hash, and pairs lo..hi apart are seeds, which are extended word by word.

A stretch whose smallest period is q is found at the multiples of q as well, with the same ends; the smallest is kept.
Words are compared as whole byte strings (numbers of a dictionary); hashes only name seeds.

Every document is worked on in its row: no shuffle. Memory: a few numbers for each word of the texts that are worked on
together (about SLICE of text, or one text where it is longer). Null, empty or wordless text: no words, no runs, collapsed
text empty. Null doc_id, repeated rows: as any other row. Empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import slices
from fieldmill.llm.shingles import BASE, INVERSE, U64, mix, powers
from fieldmill.llm.words import words_of

#: Longest period that is looked for by comparing the text with itself at that lag.
SHORT = 16
#: Bytes of text that are worked on together.
SLICE = 4 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def slid(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each window of so many neighbours."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[:-rest], x[rest:]) if rest else x


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some window of so many neighbours; of equal ones all."""
    low = slid(np.minimum, x, width)
    edge = np.zeros(width - 1, x.dtype)
    return np.flatnonzero(slid(np.maximum, np.concatenate([edge, low, edge]), width) == x)


def place_hashes(sums: np.ndarray, n: int, size: int) -> np.ndarray:
    """The hash of the `size` words from each place on, among the first n words."""
    with np.errstate(over="ignore"):
        return mix((sums[size:n + 1] - sums[:n + 1 - size]) * powers(INVERSE, n + 1 - size))


def equal_from(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The first place from `at` on, up to stop, where the word `lag` places on is another."""
    step = 64
    while at < stop:
        end = min(at + step, stop)
        differ = np.flatnonzero(ids[at:end] != ids[at + lag:end + lag])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return stop


def equal_back(ids: np.ndarray, at: int, lag: int, first: int) -> int:
    """The first place of the stretch before `at` in which every word equals the one `lag` places on."""
    step = 64
    while at > first:
        low = max(at - step, first)
        differ = np.flatnonzero(ids[low:at] != ids[low + lag:at + lag])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, step = low, step * 2
    return first


def short_stretches(ids: np.ndarray, left: np.ndarray, lag: int, least: int) -> np.ndarray:
    """(start, length, lag) of the maximal stretches in which words `lag` apart are equal."""
    if len(ids) <= lag:
        return np.empty((0, 3), np.int64)
    at = np.flatnonzero((ids[:-lag] == ids[lag:]) & (left[:-lag] > lag))
    if not len(at):
        return np.empty((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    length = last - first + 1 + lag
    keep = length >= least
    return np.stack([first[keep], length[keep], np.full(keep.sum(), lag)], 1)


def scale_stretches(ids: np.ndarray, sums: np.ndarray, left: np.ndarray, begin: np.ndarray, n: int, lo: int, hi: int,
                    min_words: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches of periods lo..hi, from equal neighbouring window minima."""
    width = 2 * lo - hi + 1
    if n < hi + width:
        return []
    hashes = place_hashes(sums, n, hi)
    at = window_minima(hashes, width)
    values = hashes[at]
    order = np.argsort(values, kind="stable")
    values, at = values[order], at[order]
    apart = at[1:] - at[:-1]
    seed = np.flatnonzero((values[1:] == values[:-1]) & (apart >= lo) & (apart <= hi) & (left[at[:-1]] > apart))
    found, lag, end = [], 0, 0
    for d, p in sorted(zip(apart[seed].tolist(), at[:-1][seed].tolist(), strict=True)):
        if d == lag and p < end:
            continue
        if ids[p] != ids[p + d]:
            continue
        start = equal_back(ids, p, d, int(begin[p]))
        lag, end = d, equal_from(ids, p, d, p + int(left[p]) - d)
        if end - start + d >= max(min_words, 3 * d):
            found.append((start, end - start + d, d))
    return found


def runs_in(ids: np.ndarray, bounds: np.ndarray, min_words: int = 24) -> np.ndarray:
    """(text, start in the text, length, period) of every run, ordered by text, start and period.

    ids: the words of all texts in turn, as numbers; bounds: where each text begins, and the end of the last.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")  # longest first: the texts that are long enough for a scale stand at the front
    order = order[:np.searchsorted(-sizes[order], -min_words, side="right")]
    lengths = sizes[order]
    if not len(order):
        return np.empty((0, 4), np.int64)
    new = np.concatenate([[0], np.cumsum(lengths)])
    begin = np.repeat(new[:-1], lengths)
    place = np.arange(new[-1])
    ids = ids[np.repeat(bounds[order], lengths) + place - begin]
    left = np.repeat(new[1:], lengths) - place
    found = [short_stretches(ids, left, q, max(min_words, 3 * q)) for q in range(1, SHORT + 1)]
    lo = SHORT + 1
    if lengths[0] >= 3 * lo:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(ids) + 1, U64)
            np.cumsum(mix(ids.astype(U64) + U64(1)) * powers(BASE, len(ids)), out=sums[1:])
    while lengths[0] >= 3 * lo:
        hi = lo * 3 // 2
        n = int(new[np.searchsorted(-lengths, -3 * lo, side="right")])
        more = scale_stretches(ids, sums, left, begin, n, lo, hi, min_words)
        found.append(np.array(more, np.int64).reshape(-1, 3))
        lo = hi + 1
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # one stretch, several lags: the smallest is its period
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    text = np.searchsorted(new, runs[:, 0], side="right") - 1
    out = np.stack([order[text], runs[:, 0] - new[text], runs[:, 1], runs[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept_words(n: int, bounds: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Per word whether no run contains it after that run's first period."""
    if not len(runs):
        return np.ones(n, bool)
    change = np.zeros(n + 1, np.int64)
    start = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, min_words: int = 24) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, runs (by start, then period; starts are word numbers from 0), collapsed.

    collapsed: the words that no run holds after its first period, joined by one space.
    """
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = words_of(part.column("text"))
                ids = found.words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                runs = runs_in(ids, found.bounds, min_words)
                keep = kept_words(len(ids), found.bounds, runs)
                kept = np.concatenate([[0], np.cumsum(keep)])[found.bounds]
                words = found.words if keep.all() else found.words.filter(pa.array(keep))
                lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words)
                collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                ends = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                columns = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(found.bounds), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), columns), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(detect, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def greatest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones; null without runs."""
    more = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.lit(0)), more)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten repeats itself from some word on, as its id says.

    With h the crc32 of the decimal doc_id and g = h div 10: if h % 10 = 0 and the text has n > 0 words, it goes on from word
    a = g % n with the p = 1 + (n - a) div (3 + g % 8) words there, over and over, to the same number of words. A null
    doc_id has no crc32: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("_h"))
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", F.expr("case when _n > 0 then (_h div 10) % _n end").cast("int"))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)").cast("int"))
    rest = F.col("_n") - F.col("_a")
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.expr("cast(ceil((_n - _a) / _p) as int)")))
    changed = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), rest))
    return rows.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))
