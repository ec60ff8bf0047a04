"""Ids of whole texts with a tokenizer file of the tokenizers library, a batch of texts at a time.

The texts of a batch are cut into units over their bytes at once: no piece of a byte-level tokenizer goes from a non-space on into a
space, so a text has the ids of its units one after the other (a unit: what stands between two such crossings; for tokenizers that drop
white space, what stands between blanks and line feeds). Where letters end in a mark, or begin behind a single line feed, a piece
ends as well, and a unit with it: words and marks meet again more often than words with their marks. Arrow tells the distinct units of the batch, each of which is looked up or
encoded once, and numpy lays their ids out in the order of the texts. A worker remembers units over its tasks, in two generations
of a bounded number of short units. A text that holds the string of a special token goes to the library whole, which knows what to do with it.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldmill.llm.units import BYTE_SIGNS, CROSSING

#: White space other than blank and line feed, as Python's (and the pre-tokenizers') \\s has it.
ODD_SPACE = "[" + "".join(re.escape(c) for c in map(chr, range(0x3100)) if c.isspace() and c not in " \n") + "]"
#: Letters of one piece, with a blank before them or not.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
BYTES = np.arange(256)
LETTER = ((BYTES | 32) > 96) & ((BYTES | 32) < 123)
#: ASCII marks that end a run of letters: no apostrophe, which may begin a contraction.
MARK = (BYTES > 32) & (BYTES < 127) & ~LETTER & ~np.isin(BYTES, list(b"0123456789'"))
#: Bytes of text that are encoded together.
SLICE = 4 << 20
#: Units that a worker remembers in a generation; longer ones than LONGEST_KEPT bytes are encoded each time.
KEPT, LONGEST_KEPT = 150_000, 256


BLANK = BYTE_SIGNS[32]


class Memory:
    """What was met lately, in two generations: the older one is dropped when the younger one is full."""

    def __init__(self, most: int = KEPT):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: list) -> list:
        """What is known of each key; else None."""
        out = list(map(self.young.get, keys))
        old = self.old.get
        again = {}
        for i, found in enumerate(out):
            if found is None:
                found = out[i] = old(keys[i])
                if found is not None:
                    again[keys[i]] = found
        self.put(again)
        return out

    def put(self, fresh: dict) -> None:
        if len(self.young) + len(fresh) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(fresh)


class BatchEncoder:
    def __init__(self, path: str, drops_space: bool, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.drops_space, self.kind = drops_space, np.dtype(f"<u{width}")
        self.special = [(t.content, t.normalized) for t in self.library.get_added_tokens_decoder().values()]
        self.known = Memory()
        self.code = {2: "H", 4: "I"}[width]

    # ---- units

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the units of all texts, per text the number of units before it: one more than texts); no odd white space."""
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first, last = int(ends[0]), int(ends[-1])
        raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
        ends = ends - first
        blank = (raw == 32) | (raw == 10)
        opens = blank.copy() if not self.drops_space else ~blank
        opens[1:] &= ~blank[:-1] if not self.drops_space else blank[:-1]
        letter = LETTER[raw]
        opens[1:] |= MARK[raw[1:]] & letter[:-1]
        if not self.drops_space:  # a single line feed is a piece of its own
            alone = (raw[1:-1] == 10) & ~blank[:-2]
            opens[2:] |= alone & letter[2:]
        inner = ends[:-1][(ends[:-1] < len(raw))]  # where a text begins, a unit begins, whatever stands before
        opens[inner] = True if not self.drops_space else ~blank[inner]
        starts = np.flatnonzero(opens)
        places = np.append(starts, len(raw))
        if self.drops_space:
            closes = ~blank
            closes[:-1] &= blank[1:] | opens[1:]
            stops = inner[inner > 0] - 1
            closes[stops] = ~blank[stops]
            lengths = np.flatnonzero(closes) + 1 - starts
            places = np.concatenate([[0], np.cumsum(lengths)])
            raw = raw[~blank]
        made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        return made, np.searchsorted(starts, ends)

    # ---- ids of units

    def many(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array(self.code, e.ids).tobytes() for e in found]

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Words go to the model without the steps before; all other units to the library."""
        out = self.known.get(units)
        new = [i for i, found in enumerate(out) if found is None]
        others, is_word, tokenize, code, lower = [], WORD.fullmatch, self.library.model.tokenize, self.code, self.drops_space
        for i in new:
            unit = units[i]
            word = unit.decode()
            shown = word.lower() if lower else word
            if not unit.isascii():
                shown = shown.encode().decode("latin-1").translate(BYTE_SIGNS)
            elif shown[0] == " ":
                shown = BLANK + shown[1:]
            if is_word(word):
                out[i] = array(code, [t.id for t in tokenize(shown)]).tobytes()
            else:
                others.append(i)
        for i, found in zip(others, self.many([units[i].decode() for i in others]), strict=True):
            out[i] = found
        self.known.put({units[i]: out[i] for i in new if len(units[i]) <= LONGEST_KEPT})
        return out

    # ---- texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, where each text's ids begin and the last one's end); null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        whole = np.zeros(n, bool)
        for content, normalized in self.special:
            whole |= pc.match_substring(texts, content, ignore_case=normalized).to_numpy(zero_copy_only=False)
        odd = np.zeros(n, bool)
        if not self.drops_space:
            odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) & ~whole
        plain = ~whole & ~odd
        made, bounds = self.units(texts if plain.all() else texts.filter(pa.array(plain)))
        if odd.any():
            cut = [CROSSING.split(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
            made = pa.concat_arrays([made, pa.array([u.encode() for units in cut for u in units], pa.large_binary())])
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(units) for units in cut])])
        coded = made.dictionary_encode()
        known = self.ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), self.kind)
        sizes = np.array([len(k) for k in known], np.int64) // self.kind.itemsize
        unit = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[unit]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        shift = (np.cumsum(sizes) - sizes)[unit] - stops[:-1]
        ids = flat[np.arange(stops[-1]) + np.repeat(shift, lengths)]
        ends = stops[bounds]
        if plain.all():
            return ids, ends
        # back into the order of the texts
        parts: list[np.ndarray] = [np.empty(0, self.kind)] * n
        for k, i in enumerate(np.concatenate([np.flatnonzero(plain), np.flatnonzero(odd)]).tolist()):
            parts[i] = ids[ends[k]:ends[k + 1]]
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.frombuffer(self.many([texts[i].as_py()])[0], self.kind)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=4)
def batch_encoder(path: str, drops_space: bool, width: int = 4) -> BatchEncoder:
    """One per worker and file: it remembers units over the tasks."""
    return BatchEncoder(path, drops_space, width)
