"""Collocated phrases of two or three words per language, counted exactly by minimal perfect hashing.

Texts are parsed as arrays of bytes: word bounds, pieces and a 64-bit number for each word of a language come from
numpy steps over some megabytes at a time.  Two words that share a number are noticed, as all distinct
words are grouped, and the numbers are drawn anew.

Candidates come level by level.  Words are counted; a pair is looked at only where both of its words
are frequent enough, and a triple only where both of its pairs are, as a bitmap of bounded size tells: a false
bit keeps a phrase too many and never loses one.  Rows are added up per task before they are exchanged.

All candidates and their parts then go into minimal perfect hashes of at most MOST_SLOTS keys each, built level
by level from bit arrays, with the keys stored by slot: a phrase that is no candidate falls on some slot and is
told by its key.  Mappers count slots with bincount into one numpy array, tasks' arrays are added up as a
tree, and a phrase's count and those of the parts of its cuts are read by slot.  More candidates than
MOST_SLOTS take one pass over the texts for each such block, so memory is bounded at every size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, ship, shuffle_partitions, small_batches
from .common import OWN
from .tokens import rows_of

#: Keys of a minimal perfect hash, a proven bound of what is broadcast and brought to the driver: 32 bytes a key.
MOST_SLOTS = 4_000_000
#: Bits of a bitmap of frequent words or pairs: so many a key, but no more than MOST_BITS; parts that it is built in.
KEY_BITS, LEAST_BITS, MOST_BITS, PARTS = 32, 1 << 16, 1 << 27, 64
#: Bytes of text that are parsed at a time, and bytes of a word that are numbered by the vectorised rule.
CHUNK, LONGEST = 1 << 20, 64
#: Keys that a task adds up before it passes them on, and slots of a row of counts.
HELD, SLICE = 400_000, 1 << 16
#: Sums that tasks' arrays meet in before they are added up once more.
LEGS = 64
#: Rows that a salted share of a language's phrases is ranked in, in parts.
SALTS = 64
UNKNOWN = "und"

#: 0: of a word, 1: blank between words, 2: ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Numbering:
    """Numbers of words: a sum of random values of its bytes times powers, mixed with its length and language."""

    def __init__(self, seed: int):
        rng = np.random.default_rng([seed, 1])
        self.seed = seed
        self.value = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.value[ord("A") : ord("Z") + 1] = self.value[ord("a") : ord("z") + 1]
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONGEST, rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]), dtype=np.uint64)

    def __call__(self, data: bytes, letters, offset, first, starts, ends, language) -> np.ndarray:
        h = np.add.reduceat(self.value[letters] * self.power[offset], first)
        h = _mix(h + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > LONGEST):
            h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].lower(), self.seed)
        w = _mix(h ^ language)
        w[w == 0] = 1
        return w

    def language(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace"), self.seed)


class Chunk:
    """Words of some texts in their order: number w, whether the next word is joined (of the same piece), bounds.

    skip: so many words were counted before and are there for the phrases that begin in them.
    """

    def __init__(self, parts: list[tuple[str, bytes]], numbering: Numbering, skip: int = 0, second: Numbering | None = None):
        self.data = data = b"\n".join([t for _, t in parts]) + b"\n"
        u = np.frombuffer(data, np.uint8)
        kind = KIND[u]
        word = kind == 0
        edge = np.diff(word.view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.starts)
        self.joined, self.skip = np.zeros(n, bool), skip
        self.parts = parts
        self.part = np.searchsorted(np.cumsum([len(t) + 1 for _, t in parts]), self.starts, "right")
        if not n:
            self.w = self.w2 = np.empty(0, np.uint64)
            return
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.joined[:-1] = piece[1:] == piece[:-1]
        lengths = self.ends - self.starts
        letters = u[word]
        first = np.cumsum(lengths) - lengths
        offset = np.minimum(np.arange(len(letters)) - np.repeat(first, lengths), LONGEST)
        number = lambda by: by(data, letters, offset, first, self.starts, self.ends, np.array([by.language(g) for g, _ in parts], np.uint64)[self.part])
        self.w = number(numbering)
        self.w2 = number(second) if second else None


def chunks(batches, numbering: Numbering, second: Numbering | None = None):
    """Chunks of the batches' texts.  A very long one is cut at blanks or ends of pieces, and where it is at a
    blank the next chunk begins with the two words before it once more."""
    held, size = [], 0
    for batch in batches:
        for lang, text in rows_of(batch, OWN + "lang", OWN + "text"):
            data = text.encode("utf-8", "replace")
            if len(data) > CHUNK:
                yield from _long_chunks(lang, data, numbering, second)
                continue
            held.append((lang, data))
            size += len(data) + 1
            if size >= CHUNK:
                yield Chunk(held, numbering, 0, second)
                held, size = [], 0
    if held:
        yield Chunk(held, numbering, 0, second)


def _long_chunks(lang: str, data: bytes, numbering: Numbering, second: Numbering | None):
    begin, cut, skip = 0, 0, 0
    while cut < len(data):
        gap = _GAP.search(data, cut + CHUNK)
        cut = gap.start() if gap else len(data)
        c = Chunk([(lang, data[begin:cut])], numbering, skip, second)
        yield c
        skip = min(2, len(c.starts))
        if skip and cut < len(data) and data[cut] in b" \t":
            begin += int(c.starts[-skip])
        else:
            begin, skip = cut, 0


class Tally:
    """Counts by keys of some 64-bit columns, added up in a task."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, *columns: np.ndarray):
        """Occurrences, one a place; gives batches when enough are held."""
        if not len(columns[0]):
            return
        self.parts.append(_added(list(columns), np.ones(len(columns[0]), np.int64)))
        self.size += len(self.parts[-1][1])
        if self.size > 2 * HELD:
            self._merge()
            if self.size > HELD:
                yield self._out()

    def _merge(self):
        cols, n = zip(*self.parts)
        self.parts = [_added([np.concatenate(c) for c in zip(*cols)], np.concatenate(n))]
        self.size = len(self.parts[0][1])

    def _out(self) -> pa.RecordBatch:
        (cols, n), self.parts, self.size = self.parts[0], [], 0
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols), pa.array(n)], [*(f"w{k + 1}" for k in range(self.width)), "n"])

    def rest(self):
        if self.parts:
            self._merge()
            yield self._out()


def _added(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    begins = np.flatnonzero(fresh)
    return [c[begins] for c in columns], np.add.reduceat(n[order], begins)


def _place(bits: int, *columns: np.ndarray) -> np.ndarray:
    """The bit of a word or pair among so many."""
    x = columns[0]
    for c in columns[1:]:
        x = _mix(x) * np.uint64(3) ^ c
    return _mix(x) % np.uint64(bits)


def _set(bits: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    at = _place(8 * len(bits), *columns)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bitmap(keys: DataFrame, width: int) -> np.ndarray:
    """The bitmap of keys (w1 and on); each part of it is made by one task."""
    spark = keys.sparkSession
    names = [f"w{k + 1}" for k in range(width)]
    size = LEAST_BITS
    wanted = KEY_BITS * keys.count()
    while size < min(wanted, MOST_BITS):
        size *= 2
    per = size // 8 // PARTS

    def places(batches):
        for b in batches:
            at = _place(size, *(b.column(c).to_numpy().view(np.uint64) for c in names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // (8 * per)).astype(np.int32)), pa.array(at)], ["part", "at"])

    def parts(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column("part").to_numpy(), b.column("at").to_numpy()
            for p in np.unique(part):
                own = at[part == p] - int(p) * 8 * per
                bits = out.setdefault(int(p), np.zeros(per, np.uint8))
                np.bitwise_or.at(bits, own >> 3, np.left_shift(np.uint8(1), (own & 7).astype(np.uint8)))
        for p, bits in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    dealt = keys.select(*names).mapInArrow(places, "part int, at long").repartition(min(PARTS, shuffle_partitions(spark)), "part")
    whole = np.zeros(size // 8, np.uint8)
    for p, bits in dealt.mapInArrow(parts, "part int, bits binary").collect():  # MOST_BITS bits at most
        whole[p * per : (p + 1) * per] = np.frombuffer(bits, np.uint8)
    return whole


class PerfectHash:
    """A minimal perfect hash of distinct keys of three columns, which are stored by slot.

    A level is a bit array twice as long as the keys left; a key that has its bit to itself is placed there, the
    others go to the next level.  The slot is the number of bits set before a key's bit.
    """

    def __init__(self, keys: list[np.ndarray]):
        n = len(keys[0])
        self.seed = 0
        while len(np.unique(x := self._number(keys))) < n:
            self.seed += 1
            if self.seed > 8:
                raise ValueError("keys of a perfect hash must be distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before, left = 0, np.arange(n)
        while len(left):
            size = 64 * (1 + 2 * len(left) // 64)
            at = self._at(x[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words)
            self.levels.append((words, before + np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]])))
            before += int(counts.sum(dtype=np.int64))
            left = left[~alone]
        self.size = n
        slot = self._slot(x)
        self.keys = [np.empty(n, np.uint64) for _ in keys]
        for stored, c in zip(self.keys, keys):
            stored[slot] = c

    def _number(self, keys) -> np.ndarray:
        x = np.full(len(keys[0]), self.seed + 1, np.uint64)
        for c in keys:
            x = _mix(x * np.uint64(5) ^ c)
        return x

    @staticmethod
    def _at(x: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(x + np.uint64(0x5851F42D4C957F2D * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        left = np.arange(len(x))
        for level, (words, before) in enumerate(self.levels):
            at = self._at(x[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            under = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = before[at[hit] >> 6] + np.bitwise_count(under)
            left = left[~hit]
            if not len(left):
                break
        return out

    def slots(self, *keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that aren't among the stored ones."""
        zero = np.zeros(len(keys[0]), np.uint64)
        keys = [*keys, *[zero] * (3 - len(keys))]
        slot = self._slot(self._number(keys))
        for stored, c in zip(self.keys, keys):
            slot[stored[slot] != c] = -1
        return slot


def _places(c: Chunk, words: np.ndarray | None, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs begin whose words, and where triples begin whose pairs, have their bits set (without bits: none)."""
    none = np.empty(0, np.int64)
    if len(c.w) < 2:
        return none, none
    frequent = _set(words, c.w)
    two = c.joined[:-1] & frequent[:-1] & frequent[1:]
    if pairs is None or len(c.w) < 3:
        at = np.flatnonzero(two)
        return at[at >= c.skip - 1], none
    at = np.flatnonzero(two)
    good = np.zeros(len(two), bool)
    good[at] = _set(pairs, c.w[at], c.w[at + 1])
    three = np.flatnonzero(good[:-1] & good[1:])
    return at[at >= c.skip - 1], three[three >= c.skip - 2]


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, w1 and n of all words."""

    def run(batches):
        numbering, second = Numbering(seed), Numbering(seed + 1000)
        for c in chunks(batches, numbering, second):
            w, w2 = c.w[c.skip :], c.w2[c.skip :]
            if not len(w):
                continue
            # by both numbers, so that words which share the first are seen
            order = np.lexsort((w2, w))
            fresh = np.ones(len(w), bool)
            fresh[1:] = (w[order][1:] != w[order][:-1]) | (w2[order][1:] != w2[order][:-1])
            begins = np.flatnonzero(fresh)
            at = order[begins] + c.skip
            words = [c.data[a:b].lower() for a, b in zip(c.starts[at].tolist(), c.ends[at].tolist())]
            langs = [c.parts[k][0] for k in c.part[at].tolist()]
            n = np.diff(np.append(begins, len(w)))
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words, pa.binary()), pa.array(c.w[at].view(np.int64)), pa.array(n)], ["lang", "word", "w1", "n"])

    found = texts.mapInArrow(run, "lang string, word binary, w1 long, n long")
    return found.groupBy("w1", "lang", "word").agg(F.sum("n").alias("n"))


def _level(texts: DataFrame, seed: int, width: int, least: int, shared) -> DataFrame:
    """Candidates of two or three words (w1 and on) whose parts are frequent, with a count of `least` or more."""

    def run(batches):
        numbering, tally = Numbering(seed), Tally(width)
        for c in chunks(batches, numbering):
            at = _places(c, *shared.value)[width - 2]
            yield from tally.add(*(c.w[at + k] for k in range(width)))
        yield from tally.rest()

    names = [f"w{k + 1}" for k in range(width)]
    rows = texts.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n long")
    return rows.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(*names)


COUNTS = "slice int, leg int, counts binary"


def slot_counts(texts: DataFrame, seed: int, block, bits) -> np.ndarray:
    """How often each key of a block occurs: arrays of the tasks, added up as a tree; block and bits are broadcast."""
    spark = texts.sparkSession

    def run(batches):
        table, numbering = block.value, Numbering(seed)
        total = np.zeros(table.size, np.int64)
        for c in chunks(batches, numbering):
            two, three = _places(c, *bits.value)
            found = [table.slots(c.w[c.skip :]), table.slots(c.w[two], c.w[two + 1]), table.slots(c.w[three], c.w[three + 1], c.w[three + 2])]
            found = np.concatenate(found)
            total += np.bincount(found[found >= 0], minlength=table.size)
        leg = TaskContext.get().partitionId() % LEGS
        for k in range(0, table.size, SLICE):
            part = total[k : k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([leg], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "leg", "counts"])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, leg, counts in rows_of(b, "slice", "leg", "counts"):
                x = np.frombuffer(counts, np.int64)
                sums[k, leg] = sums[k, leg] + x if (k, leg) in sums else x
        for (k, leg), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([leg], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "leg", "counts"])

    parts = shuffle_partitions(spark)
    out = np.zeros(block.value.size, np.int64)
    with small_batches(spark, 32):
        legs = texts.mapInArrow(run, COUNTS).repartition(parts, "slice", "leg").mapInArrow(add, COUNTS)
        whole = legs.withColumn("leg", F.lit(0)).repartition(parts, "slice").mapInArrow(add, COUNTS)
        for k, _, counts in whole.collect():  # 8 bytes for each of at most MOST_SLOTS slots
            out[k * SLICE : k * SLICE + SLICE] += np.frombuffer(counts, np.int64)
    return out


#: a phrase's count, and those of the first part and the rest when it is cut after one word and after two.
READ = ("a", "l1", "r1", "l2", "r2")
CANDIDATE = "w1 long, w2 long, w3 long, " + ", ".join(f"{c} long" for c in READ)


def read_by_slot(candidates: DataFrame, block) -> DataFrame:
    """candidates with those counts filled in whose keys the block has; block: broadcast perfect hash and counts."""

    def run(batches):
        table, counts = block.value
        for b in batches:
            w1, w2, w3 = (b.column(f"w{k}").to_numpy().view(np.uint64) for k in (1, 2, 3))
            none = np.zeros(len(w1), np.uint64)
            three = w3 != 0
            keys = {"a": (w1, w2, w3), "l1": (w1, none, none), "r1": (w2, w3, none), "l2": (w1, w2, none), "r2": (w3, none, none)}
            cols = []
            for c, key in keys.items():
                slot = table.slots(*key)
                have = (slot >= 0) & (three | (c not in ("l2", "r2")))
                old = b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                own = pa.array(np.where(have, counts[slot] if len(counts) else 0, 0), pa.int64(), mask=~have)
                cols.append(own if np.isnan(old).all() else pa.compute.coalesce(own, b.column(c)))
            yield pa.RecordBatch.from_arrays([b.column("w1"), b.column("w2"), b.column("w3"), *cols], ["w1", "w2", "w3", *READ])

    return candidates.mapInArrow(run, CANDIDATE)


def cut_score(a: int, l1: int, r1: int, l2: int | None, r2: int | None) -> tuple[int, int, int]:
    """score, l and r of the lowest-scoring cut, of equals the first; whole numbers of any length."""
    best = (1000000 * a * a // (l1 * r1), l1, r1)
    if l2 is not None:
        other = 1000000 * a * a // (l2 * r2)
        if other < best[0]:
            best = (other, l2, r2)
    return best


def _scored(read: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cut = [cut_score(*r) for r in zip(*(b.column(c).to_pylist() for c in READ))]
            yield pa.RecordBatch.from_arrays([b.column("w1"), b.column("w2"), b.column("w3"), b.column("a"), *(pa.array(x, pa.int64()) for x in zip(*cut))], ["w1", "w2", "w3", "a", "score", "l", "r"])

    return read.mapInArrow(run, "w1 long, w2 long, w3 long, a long, score long, l long, r long")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, top: int = 2000, cover: int = 50, most_slots: int | None = None) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    A-Z is lower-cased; texts are cut at .,;:!? and line ends into pieces and those at blanks and tabs into
    words.  n counts a language's words, a a phrase's occurrences within pieces.  Phrases of two or three words
    with a >= least are candidates.  l and r are the counts of both parts of the cut whose
    floor(1000000 * a * a / (l * r)) is least (of equals the first), which is the score.  A candidate is dropped
    whose words lie in a longer candidate with 100 * its count >= cover * a.  Order: score and a descending, then
    the phrase's bytes.

    A null language is `und`, together with texts marked so; null and empty texts have no words; repeated rows
    count each; languages without a candidate, and an empty table, give no rows.  Further columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    most = most_slots or MOST_SLOTS
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias(OWN + "lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(OWN + "text"))
    with small_batches(spark):
        for seed in range(8):
            counts = materialise(word_counts(texts, seed), "phrase-words")
            if counts.groupBy("w1").count().filter("count > 1").isEmpty():
                break
        else:
            raise RuntimeError("words share numbers under every seed")
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        words = counts.filter(F.col("n") >= least).select("w1", "lang", "word")
        bits = [bitmap(words, 1), None]
        shared = spark.sparkContext.broadcast(bits)
        pairs = materialise(_level(texts, seed, 2, least, shared), "phrase-pairs")
        bits[1] = bitmap(pairs, 2)
        shared.unpersist()
        shared = spark.sparkContext.broadcast(bits)
        triples = materialise(_level(texts, seed, 3, least, shared), "phrase-triples")
    none = F.lit(0).cast("long")
    candidates = pairs.select("w1", "w2", none.alias("w3")).union(triples)
    keys = words.select("w1", none.alias("w2"), none.alias("w3")).union(candidates)
    read = candidates.select("w1", "w2", "w3", *(F.lit(None).cast("long").alias(c) for c in READ))
    # so many blocks that none exceeds the bound, though a hash deals them
    blocks, total = 1, keys.count()
    if total > most:
        blocks = -(-total * 11 // (10 * most))
    own = F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(blocks))
    for b in range(blocks if total else 0):
        columns = keys.filter(own == b).toArrow()
        if columns.num_rows > 1.2 * most + 1000:
            raise RuntimeError(f"a block has {columns.num_rows} keys")
        table = PerfectHash([columns.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2", "w3")])
        block = spark.sparkContext.broadcast(table)
        with small_batches(spark):
            counted = slot_counts(texts, seed, block, shared)
        block.unpersist()
        read = materialise(read_by_slot(read, spark.sparkContext.broadcast((table, counted))), "phrase-read")
    scored = materialise(_scored(read.filter(F.col("a") >= least)), "phrase-scored")
    # a pair goes that lies in a triple of enough occurrences
    inside = scored.filter("w3 <> 0").select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    inside = inside.groupBy(F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["w1", "w2"], "left").filter((F.col("w3") != 0) | F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
    named = lambda k: words.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"s{k}"), *([F.col("lang")] if k == 1 else []))
    kept = kept.join(named(1), "w1").join(named(2), "w2").join(named(3), "w3", "left")
    phrase = F.concat_ws(" ", F.col("s1").cast("string"), F.col("s2").cast("string"), F.col("s3").cast("string"))
    kept = kept.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within salted shares, so that no task sorts all of a language's phrases
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = salted.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
