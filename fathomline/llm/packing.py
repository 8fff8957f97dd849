"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Documents are encoded where they are read; only (identifier, piece, length, checksum) is shuffled.
Each packing partition holds a share of all pieces, dealt by hash, and places them longest first: a
piece goes into the open sequence, or a new one, after which the sum over gaps of (open sequences with
that gap) squared is smallest.  A repair step follows, which is no part of that rule: sequences that are
left with a wide gap are taken apart, and their pieces are placed by the same sum over open sequences
only, a new one being opened where nothing fits; the second placing holds if it needs fewer sequences.

Memory: a partition keeps its open sequences and its pieces' places, some tens of bytes a piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship, shuffle_partitions
from .common import OWN
from .tokens import encoder, rows_of

CAPACITY = 4096
#: Pieces that a packing partition should have.
SHARE = 8_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Deals out pieces without an identifier: the number of the task that read it and how many like it came before there.
DEAL = OWN + "deal long"


class SumOfSquares:
    """Open sequences by gap; place() returns the sequence and the offset in it.

    Only gaps that are open now are looked at.  Ties go to the smallest gap, and a new sequence is
    opened only where that is strictly better or nothing fits.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[int]] = {}
        self.gaps: list[int] = []
        self.made = 0

    def _count(self, gap: int) -> int:
        return len(self.open.get(gap, ()))

    def _add(self, gap: int, sequence: int) -> None:
        if gap:
            if gap not in self.open:
                self.open[gap] = []
                bisect.insort(self.gaps, gap)
            self.open[gap].append(sequence)

    def _take(self, gap: int) -> int:
        sequence = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap]
            self.gaps.pop(bisect.bisect_left(self.gaps, gap))
        return sequence

    def place(self, size: int, may_open: bool = True) -> tuple[int, int]:
        best, chosen = None, 0
        for gap in self.gaps[bisect.bisect_left(self.gaps, size) :]:
            rest = gap - size
            # change of the sum of squares: one fewer with this gap, one more with the rest
            change = 1 - 2 * self._count(gap) + (2 * self._count(rest) + 1 if rest else 0)
            if best is None or change < best:
                best, chosen = change, gap
        fresh = 2 * self._count(self.capacity - size) + 1 if size < self.capacity else 0
        if best is None or (may_open and fresh < best):
            sequence, chosen = self.made, self.capacity
            self.made += 1
        else:
            sequence = self._take(chosen)
        self._add(chosen - size, sequence)
        return sequence, self.capacity - chosen


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(sequence, offset) of each size, all of which are from 1 to capacity."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    first = SumOfSquares(capacity)
    at = [(0, 0)] * len(sizes)
    for k in order:
        at[k] = first.place(sizes[k])
    # the repair step
    wide = {s for gap, held in first.open.items() if gap * 50 >= capacity for s in held}
    if len(wide) > 1:
        loose = [k for k in order if at[k][0] in wide]
        again = SumOfSquares(capacity)
        second = {k: again.place(sizes[k], may_open=False) for k in loose}
        if again.made < len(wide):
            for k, (s, o) in second.items():
                at[k] = (first.made + s, o)
    return at


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids: doc_id, piece, start, length, ids_crc32 (and ids), and a
    number by which pieces that are alike and have no identifier are dealt apart."""
    ship(docs.sparkSession)
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        code = encoder(tokenizer)
        task, alike = TaskContext.get().partitionId() << 40, Counter()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            size = 0
            for doc, ids in code.encode_each(rows_of(batch, OWN + "id", OWN + "text")):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    crc, deal = zlib.crc32(part), 0
                    if doc is None:
                        deal = task + alike[k, crc]
                        alike[k, crc] += 1
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, crc, deal, part if with_ids else None)):
                        c.append(v)
                    size += len(part) if with_ids else 0
                if size > 1 << 24:
                    yield out(cols)
                    cols, size = [[] for _ in cols], 0
            yield out(cols)

    def out(cols):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", OWN + "deal", "ids"]
        n = 7 if with_ids else 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])

    read = docs.select(F.col(id_col).cast("long").alias(OWN + "id"), F.col(text_col).cast("string").alias(OWN + "text"))
    return read.mapInArrow(run, f"{PIECES}, {DEAL}" + (", ids binary" if with_ids else ""))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """pieces, as encode_pieces gives them, with sequence_id and offset."""
    spark = pieces.sparkSession
    ship(spark)
    n = partitions or shuffle_partitions(spark)
    dealt = pieces.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32", OWN + "deal")).drop(OWN + "deal").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        base = TaskContext.get().partitionId() << 40
        whole = pa.Table.from_batches(held)
        at = pack(whole.column("length").to_pylist(), capacity)
        whole = whole.append_column("sequence_id", pa.array([base + s for s, _ in at], pa.int64())).append_column("offset", pa.array([o for _, o in at], pa.int64()))
        yield from whole.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document's ids and end_id are cut into pieces of `capacity` ids if there are more of them.  A
    null text counts as empty and is its end alone.  Null identifiers and repeated rows are packed like
    others, a row of the result for each.  An empty table gives an empty result; further columns of
    docs are not read.
    """
    if partitions is None:
        # by the number of documents, which is read from the files' footers
        n = docs.count()
        partitions = max(1, -(-n // SHARE))
    return place_pieces(encode_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity, partitions)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids (binary, little-endian, 32 bits each).

    Identifiers must be unique here, as pieces are joined to their places by (doc_id, piece).
    """
    pieces = encode_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids=True).select("doc_id", "piece", "ids")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))  # at most `capacity` ids a group
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
