"""Byte-level BPE from a rank file: encoding in padded numpy matrices, decoding, both per Arrow batch.

Pieces of the pre-tokenizer pattern become rows of token ids, padded to the width of their length bucket. In every round
each row merges its leftmost pair of least rank: pair ranks come from an open-addressing hash table in numpy, the merged
column is squeezed out, rows without a pair left leave the matrix. Pieces over LONGEST bytes, for which rounds over a
matrix would be quadratic, take the same merges from a heap. A piece that is a token itself is that token.

Null text: no ids, decoded to the empty text. Any bytes can be decoded; ids outside the file raise an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import slices, texts
from fieldmill.llm.units import UnitEncoder

NONE = np.iinfo(np.int32).max
LONGEST = 256
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, LONGEST)
#: Cells of one matrix at most; more rows make more matrices.
CELLS = 1 << 20
ENCODED = "doc_id long, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) to the id of their merge, which is its rank; NONE for other pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._home(keys)
        while len(keys):  # the first of those that want a free cell gets it, the others go on to the next cell
            cell, first = np.unique(at, return_index=True)
            first = first[self.keys[cell] == -1]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Padding is -1 and has no pair."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        keys = left << 32 | right
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(keys[todo])
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class MatrixBpe:
    """encode_pieces() of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            token = self.ranks.get(piece)
            if token is not None:
                out[i] = [token]
            elif not piece:
                out[i] = []
            elif len(piece) > LONGEST:
                out[i] = self._from_heap(piece)
            else:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(i)
        for width, own in buckets.items():
            for k in range(0, len(own), max(1, CELLS // width)):
                part = own[k:k + max(1, CELLS // width)]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self.single[raw], -1).astype(np.int32)
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        ranks = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                for row, line in zip(rows[over].tolist(), ids[over].tolist(), strict=True):
                    out[row] = [t for t in line if t >= 0]
                on = ~over
                rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            ids[line, at] = best
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            if ranks.shape[1]:
                for shift in (-1, 0):  # the pairs that end and begin with the merged token
                    near = at + shift
                    fits = (near >= 0) & (near < ranks.shape[1])
                    own, near = line[fits], near[fits]
                    ranks[own, near] = self.pairs.look_up(ids[own, near], ids[own, near + 1])
            else:
                for row, ids_left in zip(rows.tolist(), ids[:, 0].tolist(), strict=True):
                    out[row] = [ids_left]
                break
        return out

    def _from_heap(self, piece: bytes) -> list[int]:
        """The same merges for a long piece: least rank first, leftmost among equals."""
        known, n = self.ranks.get, len(piece)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start: where its token ends, where the one before starts
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := known(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i] if alive[i] else n
            if not alive[i] or j >= n or stop[j] != end:
                continue
            stop[i], alive[j] = end, 0
            if end < n:
                before[end] = i
                if (rank := known(piece[i:stop[end]])) is not None:
                    heapq.heappush(heap, (rank, i, stop[end]))
            left = before[i]
            if left >= 0 and (rank := known(piece[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:stop[i]]])
            i = stop[i]
        return out


@lru_cache(maxsize=2)
def unit_encoder(ranks_path: str, pattern: str) -> UnitEncoder:
    """One per worker: it remembers units over the tasks."""
    bpe, cut = MatrixBpe(read_ranks(ranks_path)), regex.compile(pattern)

    def encode_many(units: list[str]) -> list[list[int]]:
        found = [cut.findall(u) for u in units]
        fresh = list({p for pieces in found for p in pieces})
        ids = dict(zip(fresh, bpe.encode_pieces([p.encode() for p in fresh]), strict=True))
        return [[t for p in pieces for t in ids[p]] for pieces in found]

    def encode_words(words: list[str], blank: bool) -> list[list[int]]:
        return bpe.encode_pieces([b" " + w.encode() if blank else w.encode() for w in words])

    # with public patterns a run of letters, with the blank before it, is one match
    return UnitEncoder(encode_many, encode_words if cut.findall(" Abé abc.,!") == [" Abé", " abc", ".,!"] else None)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids of each whole text: every match of `pattern` encoded by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder.spaced_texts(texts(part))
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                                 ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, ids) with `decoded`, the bytes that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy())])
            whole = [b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(whole, pa.binary())],
                                             ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
