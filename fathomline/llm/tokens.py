"""Whole-text encoding by a public tokenizer, fast on texts whose words recur.

Pre-tokenization never joins what white space separates, so a text is cut before each run of ASCII
white space and each unit is encoded by itself; units that recur are looked up.  Of units of Latin letters and plain
punctuation each distinct word goes straight to the tokenizer's model, all other units to the tokenizer; strings
of special tokens hold no white space, so they stay within a unit.
Texts with other white space are cut only between letters or digits of ASCII, where no rule looks across.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import worker_table

#: Entries of the table of units.  A full table stays, as frequent units came early, until most units
#: of some texts aren't in it.
MOST_UNITS = 500_000
LONGEST_UNIT = 48
#: Characters encoded at a time, so a very long text needs no memory in proportion beyond its ids.
SEGMENT = 1 << 20
#: Characters of short texts whose new units are encoded in one call.
TOGETHER = 1 << 18

#: White space beyond ASCII's, and controls that some tables count as such.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_PLAIN = re.compile("(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:|#$%&*]*)")
_SPACED_UNIT = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Without these each white space is a single space or line's end, before which a text is cut by plain replacement.
_NOT_SINGLE = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r", "\0")
_SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z])[\t-\r ]+(?=[0-9A-Za-z])")

def byte_letters() -> dict[int, str]:
    """Byte-level models write printable bytes as they are and number the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as encode(text, add_special_tokens=False) does: none is
    added, and the string of a special token within a text is that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: With a normalizer white space is dropped and case folded, without one it stays.
        self.folds = self.tokenizer.normalizer is not None
        self.letters = {k: v for k, v in byte_letters().items() if k != ord("\n")}
        #: The model by itself, for words that are already in its letters.
        self.model = self.tokenizer.model
        self.units: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        """As the library encodes it, without any shortcut."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, units: set[str]) -> None:
        """Put the ids of units into the table."""
        table, marks, match = self.units, self.marks, _PLAIN.fullmatch
        words, composed = set(), []
        for u in units:
            if m := match(u):
                head, word, tail = m.groups()
                if word not in table:
                    words.add(word)
                if head or tail:
                    composed.append((u, head, word, tail))
            else:
                table[u] = self.whole(u)
        found = self._words(words)
        for u, head, word, tail in composed:
            for mark in (head, tail):
                if mark not in marks:
                    marks[mark] = self.whole(mark)
            table[u] = marks[head] + (found.get(word) or table[word]) + marks[tail]
        for word in words & units:
            table[word] = found[word]

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words without or with a space before them."""
        shown = "\n".join(words)
        shown = (shown.lower() if self.folds else shown).encode("utf-8").decode("latin-1").translate(self.letters)
        cut = self.model.tokenize
        return {w: array("I", [t.id for t in cut(x)]).tobytes() for w, x in zip(words, shown.split("\n"))}

    def _units(self, text: str) -> list[str]:
        """Units of a text without odd white space: bare ones where case is folded, else with the white space before them."""
        if self.folds:
            return text.split()
        if any(x in text for x in _NOT_SINGLE):
            return _SPACED_UNIT.findall(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return cut if cut[0] else cut[1:]

    def _segments(self, texts: list[str]) -> list[bytes]:
        odd = [bool(_ODD_SPACE.search(t)) for t in texts]
        cut = [[] if o else self._units(t) for t, o in zip(texts, odd)]
        wanted = set().union(*cut)
        new = wanted.difference(self.units)
        full = len(self.units) + len(new) > MOST_UNITS
        if full and 5 * len(new) > 3 * len(wanted):
            self.units.clear()
            self.marks = {"": b""}
            new, full = wanted, False
        if new:
            self._learn(new)
        out = [b"".join(map(self.units.__getitem__, c)) for c in cut]
        for u in new:
            if full or len(u) > LONGEST_UNIT:
                del self.units[u]
        for k, o in enumerate(odd):
            if o:
                ends = [0, *(m.start() for m in _SAFE_CUT.finditer(texts[k])), len(texts[k])]
                out[k] = b"".join(self.whole(texts[k][a:b]) for a, b in zip(ends, ends[1:]) if a < b)
        return out

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if len(text) <= SEGMENT:
            return self._segments([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            out.append(self._segments([text[at:end]])[0])
            at = end
        return b"".join(out)

    def encode_each(self, rows):
        """(key, ids) of each (key, text), in order; short texts are encoded together."""
        held, size = [], 0
        for key, text in rows:
            text = text or ""
            if held and size + len(text) > TOGETHER:
                yield from zip([k for k, _ in held], self._segments([t for _, t in held]))
                held, size = [], 0
            if len(text) > TOGETHER:
                yield key, self.encode(text)
            else:
                held.append((key, text))
                size += len(text)
        if held:
            yield from zip([k for k, _ in held], self._segments([t for _, t in held]))


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file; Python workers are used again, so its table stays."""
    return worker_table(f"encoder {path}", lambda: Encoder(path))


def rows_of(batch, *names):
    """Rows of an Arrow batch one at a time as Python values."""
    yield from zip(*(map(lambda v: v.as_py(), batch.column(n)) for n in names))
