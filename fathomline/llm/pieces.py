"""Encoding and decoding by a public SentencePiece model of the merge type, exact by backtracking.

A segmentation is the one that merging gives if and only if each two adjacent tokens are what merging gives
for the two alone: up to the first merge across a boundary, merges on both sides go as they would by
themselves.  So tokens are placed from the left, the longest match first, as an Aho-Corasick automaton gives
it; the next token must fit the one before it, which is asked by merging the two again, each as it merges by
itself, until a pair across their boundary would go first; answers are remembered.  If no prefix of the match
fits, the position is marked in a bitfield as failed and the token before it gives way to its next shorter
prefix.  What stands before a position is the one segmentation of that prefix, so a failed position stays
failed and each is tried once.

No piece of the model has white space after anything else, so no merge crosses such a place; texts are
cut there and units that recur are looked up.  Characters that no piece has become their bytes' tokens.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import OWN, worker_table
from .tokens import rows_of

#: Stands for a blank in pieces; a fixed value of the format.
BLANK = "▁"
#: Entries of the tables of units and of pairs that were merged again.  A full table of units stays, as frequent
#: ones came early; one of pairs is begun anew.
MOST_UNITS, MOST_PAIRS = 600_000, 500_000
LONGEST_UNIT = 48
#: Characters that are cut into units at a time, and ids of an Arrow batch.
SEGMENT, BATCH_IDS = 1 << 20, 1 << 20

#: Marks before which words may be cut, and what ends a token's steps; ALONE: of a character without any.
MARKS = ".,;:!?\n"
NO_STEP = (float("-inf"), "", "")
ALONE = [NO_STEP]

_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_CUT = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, rules = proto.ModelProto.SentencePiece, model.normalizer_spec
        types = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or types & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError(f"{path}: only merge models with byte tokens and without symbols of the user's are read")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError(f"{path}: only models that leave texts as they are, but for a blank before them, are read")
        self.names = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bytes_of = {k: b for b, k in self.byte_ids.items()}
        self.hidden = {k for k, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.unknown = {k for k, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        self.unknown_text = model.trainer_spec.unk_surface
        if any(_CUT.search(p) for p in self.score):
            raise ValueError(f"{path}: a piece has white space after something else")
        #: Marks that no piece has behind a letter, so a word can be cut before them.
        self.tail = re.compile(f"({BLANK}*[A-Za-z]+)([{re.escape(''.join(c for c in MARKS if not any(re.search('[A-Za-z]' + re.escape(c), p) for p in self.score)))}\\0]+)")
        #: Pieces that merging their own characters gives, no other is ever a token; and how: of each merge
        #: its score and the first and last part after it.
        self.steps: dict[str, list[tuple[float, str, str]]] = {}
        for p in self.score:
            parts, steps = self.merged(p)
            if parts == [p]:
                self.steps[p] = [*steps, NO_STEP]
        made = self.steps.keys()
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: The next shorter token that a token begins with; its first character at least.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in made), p[0]) for p in made if len(p) > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}
        #: What an id decodes to wherever it stands, but for bytes beyond ASCII and ids without text of their own.
        self.plain = [chr(self.bytes_of[k]) if self.bytes_of.get(k, 128) < 128 else p.replace(BLANK, " ") for k, p in enumerate(self.names)]
        self.special = np.zeros(len(self.names), bool)
        self.special[[k for k in range(len(self.names)) if k in self.hidden or k in self.unknown or self.bytes_of.get(k, 0) >= 128]] = True

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """What merging gives, the best-scored pair of neighbours first and the leftmost of equals; and its steps."""
        parts, steps = list(text), []
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))

    def fit(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' text again gives the two."""
        before, after = self.steps.get(left, ALONE), self.steps.get(right, ALONE)
        i = j = 0
        x, y = left[-1], right[0]
        while True:
            a, b, across = before[i], after[j], self.score.get(x + y)
            # of equal scores the leftmost goes first
            if across is not None and a[0] < across >= b[0]:
                return False
            if a is NO_STEP and b is NO_STEP:
                return True
            if a[0] >= b[0]:
                x, i = a[2], i + 1
            else:
                y, j = b[1], j + 1

    def tokens(self, text: str) -> list[str]:
        """The segmentation of a text that has no place to cut."""
        if text in self.steps:
            return [text]
        n, pairs = len(text), self.pairs
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece  # ends ascend, so the longest comes last
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        before, at, token = "", 0, (longest[0] or text[0]) if n else ""
        while at < n:
            end = at + len(token)
            fits = not failed[end >> 3] & (1 << (end & 7))
            if fits and at:
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    fits = pairs[before, token] = self.fit(before, token)
            if fits:
                out.append(token)
                before, at = token, end
                if at < n:
                    token = longest[at] or text[at]
            elif len(token) > 1:
                token = self.shorter[token]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                before = out[-1] if out else ""
        return out

    def unit(self, text: str) -> bytes:
        """Ids of a unit as little-endian 32-bit integers."""
        ids = [self.ids.get(t, t) for t in self.tokens(text)]
        try:
            return struct.pack(f"<{len(ids)}i", *ids)
        except struct.error:  # characters that no piece has
            return b"".join(struct.pack("<i", k) for t in ids for k in ([t] if isinstance(t, int) else [self.byte_ids[b] for b in t.encode("utf-8")]))

    def _learn(self, units: list[str]) -> list[bytes]:
        known, out = self.units, []
        full = len(known) >= MOST_UNITS
        for u in units:
            found = known.get(u)
            if found is None:
                m = self.tail.fullmatch(u)
                found = b"".join(self._learn([m[1], m[2]])) if m else self.unit(u)
                if not full and len(u) <= LONGEST_UNIT:
                    known[u] = found
            out.append(found)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        text = BLANK + text.replace(" ", BLANK)
        ids, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            units = _UNIT.findall(text, at, end)
            try:
                ids += [self.units[u] for u in units]
            except KeyError:
                ids += self._learn(units)
            at = end
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids; a blank that they begin with goes, as encode() puts one there."""
        ids = np.asarray(ids, np.int64)
        if not self.special[ids].any():
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
            return text[1:] if len(ids) and self.names[ids[0]].startswith(BLANK) else text
        out: list[str] = []
        waiting = bytearray()
        leading = True
        for k in ids.tolist():
            if k in self.bytes_of:
                waiting.append(self.bytes_of[k])
                continue
            if waiting:
                out.append(utf8(bytes(waiting)))
                waiting.clear()
            if out:
                leading = False
            if k in self.hidden:
                piece = ""
            elif k in self.unknown:
                piece = self.unknown_text
            else:
                piece = self.names[k]
            if leading and piece.startswith(BLANK):
                piece, leading = piece[1:], False
            if piece:
                out.append(piece.replace(BLANK, " "))
        if waiting:
            out.append(utf8(bytes(waiting)))
        return "".join(out)


def utf8(data: bytes) -> str:
    """Characters of data; each byte that begins none is a replacement character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in range(1, 5):
            try:
                out.append(data[at : at + n].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def pieces(path: str) -> Pieces:
    """The worker's tables of that file; Python workers are used again, so they stay."""
    return worker_table(f"pieces {path}", lambda: Pieces(path))


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of integers) and decoded, the text that the ids decode to.

    Ids are those of the sentencepiece library for the whole text without begin or end.  A null or empty text
    has no ids and decodes to empty text; a null identifier stays null; repeated rows are encoded each; an
    empty table gives an empty result.  Characters that the model lacks become tokens of their UTF-8 bytes, and
    a text's own U+2581 decodes to a blank, as in the library.  Further columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches):
        code = pieces(model)
        for batch in batches:
            held, size = [], 0
            for doc, text in rows_of(batch, OWN + "id", OWN + "text"):
                held.append((doc, ids := np.frombuffer(code.encode(text), "<i4"), code.decode(ids)))
                size += len(ids)
                if size >= BATCH_IDS:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    def out(held):
        ends = np.cumsum([0, *(len(x) for _, x, _ in held)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x, _ in held])))
        return pa.RecordBatch.from_arrays([pa.array([d for d, *_ in held], pa.int64()), ids, pa.array([t for *_, t in held], pa.string())], ["doc_id", "ids", "decoded"])

    read = docs.select(F.col(id_col).cast("long").alias(OWN + "id"), F.col(text_col).cast("string").alias(OWN + "text"))
    return read.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded of rows with ids; null ids decode to null, none to empty text."""
    ship(encoded.sparkSession)

    def run(batches):
        code = pieces(model)
        for batch in batches:
            docs, ids = batch.column(OWN + "id"), batch.column(OWN + "ids")
            yield pa.RecordBatch.from_arrays([docs, pa.array([None if x is None else code.decode(x) for x in ids.to_pylist()], pa.string())], ["doc_id", "decoded"])

    read = encoded.select(F.col(id_col).cast("long").alias(OWN + "id"), F.col(ids_col).cast("array<int>").alias(OWN + "ids"))
    return read.mapInArrow(run, "doc_id long, decoded string")
