"""Ids of whole texts from encoded units.

A tokenizer that never lets a piece cross from a non-space to a space gives a text the same ids as the sequence of its
units (a unit: what stands between two such crossings). Units repeat, texts hardly do, so a worker remembers the ids of
units it has met, over all its tasks. `limit` bounds what it remembers; beyond it units met only once are forgotten.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

#: White space other than blank and newline.
ODD_SPACE = re.compile(r"[^\S \n]")
#: From a non-space to a blank or newline.
CROSSING = re.compile(r"(?<=\S)(?=[ \n])")
#: One word of Latin letters and the marks behind it (no apostrophe): two pieces for any of the tokenizers used here.
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
UNITS_KEPT = 500_000


def byte_signs() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = byte_signs()


class UnitEncoder:
    """Ids come out as little-endian bytes of `width` bytes each.

    encode_many: texts to id sequences. encode_words: runs of Latin letters, and whether a blank stands before them, to ids.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], encode_words: Callable[[list[str], bool], list] | None = None,
                 width: int = 4, limit: int = UNITS_KEPT):
        self.encode_many, self.encode_words, self.limit = encode_many, encode_words, limit
        self.code = {2: "H", 4: "I"}[width]
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.again: dict[int, set[str]] = {id(self.plain): set(), id(self.spaced): set()}

    def _forget(self) -> None:
        if len(self.plain) + len(self.spaced) <= self.limit:
            return
        for known in (self.plain, self.spaced):
            again = self.again[id(known)]
            held = {} if len(again) > self.limit // 3 else {u: known[u] for u in again}
            known.clear()
            known.update(held)
            again.clear()

    def _learn(self, known: dict[str, bytes], units: set[str], blank: bool) -> None:
        code, others, words, joined = self.code, [], set(), []
        new = units.difference(known)
        self.again[id(known)].update(units.difference(new))
        for unit in new:
            match = LATIN.fullmatch(unit) if self.encode_words else None
            if not match:
                others.append(unit)
                continue
            core, tail = match.groups()
            if core not in known:
                words.add(core)
            if tail:
                joined.append((unit, core, tail))
        if words:
            fresh = list(words)
            for word, ids in zip(fresh, self.encode_words(fresh, blank), strict=True):
                known[word] = array(code, ids).tobytes()
        for unit, core, tail in joined:
            if tail not in self.plain:
                self._learn_many(self.plain, [tail], "")
            known[unit] = known[core] + self.plain[tail]
        if others:
            self._learn_many(known, others, " " if blank else "")

    def _learn_many(self, known: dict[str, bytes], units: list[str], prefix: str) -> None:
        for unit, ids in zip(units, self.encode_many([prefix + u for u in units]), strict=True):
            known[unit] = array(self.code, ids).tobytes()

    def spaced_texts(self, texts: list[str]) -> list[bytes]:
        """For tokenizers that join a blank to the word behind it."""
        self._forget()
        firsts, rest, cut = {"\n"}, set(), []
        for text in texts:
            if not text:
                cut.append(None)
            elif (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text
                    or "\n " in text or ODD_SPACE.search(text)):
                units = CROSSING.split(text)
                firsts.update(units)
                cut.append((True, units))
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                for words in lines:
                    firsts.add(words[0])
                    rest.update(words[1:])
                cut.append((False, lines))
        self._learn(self.plain, firsts, False)
        self._learn(self.spaced, rest, True)
        plain, spaced, out = self.plain.__getitem__, self.spaced.__getitem__, []
        newline = plain("\n")
        for item in cut:
            if item is None:
                out.append(b"")
            elif item[0]:
                out.append(b"".join(map(plain, item[1])))
            else:
                parts: list[bytes] = []
                for words in item[1]:
                    if parts:
                        parts.append(newline)
                    parts.append(plain(words[0]))
                    parts.extend(map(spaced, words[1:]))
                out.append(b"".join(parts))
        return out
