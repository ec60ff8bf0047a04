"""The words of many texts as one Arrow column, found over the bytes of all of them at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from fieldmill.llm.shingles import IS_SPACE


class Words(NamedTuple):
    """words: every word of every text in turn; bounds: per text the number of words before it, one more than texts."""
    words: pa.Array
    bounds: np.ndarray
    raw: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    stops: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words are runs of other bytes than ASCII white space; null has none.

    raw: the bytes of all texts; ends: where each text begins in them, and the end of the last; starts, stops: of each word.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    ends = ends - first
    solid = ~IS_SPACE[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    # a text's first byte opens a word and its last one closes it, whatever its neighbours hold
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    opens[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=places[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(raw[solid])])
    return Words(words, np.searchsorted(starts, ends), raw, ends, starts, stops)
