"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Base of the polynomial word hash, its inverse modulo 2**64, and odd multipliers that tell the places in a shingle.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
          0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), base, U64)
            steps[0] = 1
            kept = _powers[base] = np.cumprod(steps, dtype=U64)
        if n > 1 << 23:
            _powers.pop(base)
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def lowered_bytes() -> np.ndarray:
    """Byte plus one, A-Z as a-z: no byte counts as zero in a hash."""
    table = np.arange(1, 257, dtype=U64)
    table[65:91] += U64(32)
    return table


LOWERED = lowered_bytes()
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text in turn, per text the number of words before it: one more than texts).

    Words are runs of other bytes than ASCII white space; A-Z count as a-z; null has no words.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    ends = ends - first
    solid = ~IS_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[1:] = solid[:-1]
    before[:1] = False
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(len(raw), bool)
    after[:-1] = solid[1:]
    after[-1:] = False
    inner = ends[1:][ends[1:] > 0] - 1
    after[inner] = False
    stop = np.flatnonzero(solid & ~after) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(LOWERED[raw] * powers(BASE, len(raw)), out=sums[1:])
        words = mix((sums[stop] - sums[start]) * powers(INVERSE, len(raw) + 1)[start])
    return words, np.searchsorted(start, ends)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words; of the whole sequence where it is shorter; none without words."""
    n = min(size, len(words))
    if not n:
        return words
    runs = len(words) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(runs, n, U64)
        for k in range(n):
            total += (words[k:k + runs] ^ U64(PLACES[(k + 1) % 8])) * U64(PLACES[k % 8] + 2 * (k // 8))
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes."""
    words, bounds = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def set_print(hashes: np.ndarray) -> bytes | None:
    """128 bits for a set; None for the empty one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None
