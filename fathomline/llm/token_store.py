"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of a range of identifiers, ascending, as unsigned little-endian 32-bit integers.
Each document has frames of its own (one, or more for a very long text), so a reader decompresses only
the documents it is asked for.  After them comes a frame with the file's index and then the seek table
of the public zstd seekable format: a skippable frame with each frame's compressed and decompressed
size and the low 32 bits of XXH64 of its content, then a footer.  Any zstd reader can decompress the
file as a whole.

Index frame: number of documents (64 bits), then for each document its identifier (64 bits signed),
whether that is null (8 bits) and its number of ids (64 bits), one array after another.

A task writes its file under a name of its own attempt and renames it when it is complete, so a task
that runs again replaces it by the same content.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch_path, ship, shuffle_partitions
from .common import OWN
from .tokens import encoder, rows_of

#: Fixed values of the public format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 20
LEVEL = 3

RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


def file_system(path: str):
    """(file system, path in it) of a local path or of a URI that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class StoreWriter:
    """Writes one file; add() takes documents in order."""

    def __init__(self, out, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.bytes_of_frame = out, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.seek = bytearray()
        self.frames = 0
        self.ids, self.nulls, self.counts = [], [], []
        self.size = 0

    def _frame(self, content) -> None:
        import xxhash

        packed = self.pack.compress(content)
        self.out.write(packed)
        self.size += len(packed)
        self.seek += struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.frames += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for at in range(0, len(ids), self.bytes_of_frame):
            self._frame(ids[at : at + self.bytes_of_frame])
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)

    def close(self) -> None:
        self._frame(struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "<u1").tobytes() + np.array(self.counts, "<u8").tobytes())
        table = bytes(self.seek) + struct.pack("<IBI", self.frames, HAS_CHECKSUMS, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        self.out.write(tail)
        self.size += len(tail)


class StoreReader:
    """Reads single documents of a file, which is anything with seek() and read()."""

    def __init__(self, source, frame_ids: int = FRAME_IDS):
        import zstandard

        self.source = source
        self.unpack = zstandard.ZstdDecompressor()
        end = source.seek(0, 2) if not hasattr(source, "size") else source.size()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = end - 9 - 12 * n - 8
        source.seek(start)
        head = source.read(8 + 12 * n)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE_MAGIC, 12 * n + 9):
            raise ValueError("the seek table's frame is damaged")
        table = np.frombuffer(head[8:], "<u4").reshape(n, 3)
        self.sizes, self.full, self.sums = table[:, 0].astype(np.int64), table[:, 1], table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        if self.at[-1] != start:
            raise ValueError("the seek table doesn't fit the file")
        index = self.frame(n - 1)
        m = struct.unpack("<Q", index[:8])[0]
        self.ids = np.frombuffer(index, "<i8", m, 8)
        self.nulls = np.frombuffer(index, "<u1", m, 8 + 8 * m)
        self.counts = np.frombuffer(index, "<u8", m, 8 + 9 * m).astype(np.int64)
        per = -(-self.counts // frame_ids)
        self.first = np.concatenate([[0], np.cumsum(per)])
        if self.first[-1] != n - 1:
            raise ValueError("the index doesn't fit the seek table")

    def frame(self, k: int) -> bytes:
        import xxhash

        self.source.seek(int(self.at[k]))
        content = self.unpack.decompress(self.source.read(int(self.sizes[k])), max_output_size=int(self.full[k]))
        if len(content) != self.full[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k}")
        return content

    def __len__(self) -> int:
        return len(self.ids)

    def doc_id(self, k: int) -> int | None:
        return None if self.nulls[k] else int(self.ids[k])

    def document(self, k: int):
        """Chunks of the ids of the k-th document of the file."""
        for f in range(int(self.first[k]), int(self.first[k + 1])):
            yield self.frame(f)

    def find(self, doc_id: int) -> list[int]:
        """Places in the file of a document id."""
        return [int(k) for k in np.flatnonzero((self.ids == doc_id) & (self.nulls == 0))]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, frame_ids: int = FRAME_IDS) -> list:
    """Write the files under path; returns the manifest's rows (one a file) in order of identifiers.

    The manifest is as long as there are files, and each file holds a range of a size that the number
    of partitions sets, so it stays small.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or shuffle_partitions(spark)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        code = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        final = posixpath.join(folder, f"shard-{part:06d}.zst")
        draft = posixpath.join(folder, f".{part}-{uuid.uuid4().hex}")
        with fs.open_output_stream(draft) as out:
            writer = StoreWriter(out, frame_ids=frame_ids)

            def rows():
                for b in batches:
                    yield from rows_of(b, OWN + "id", OWN + "text")

            for doc, ids in code.encode_each(rows()):
                writer.add(doc, ids + end)
            writer.close()
        if not writer.ids:
            fs.delete_file(draft)
            return
        fs.move(draft, final)
        row = [[part], [posixpath.join(path, f"shard-{part:06d}.zst")], [len(writer.ids)], [sum(writer.counts)], [writer.size]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    read = docs.select(F.col(id_col).cast("long").alias(OWN + "id"), F.col(text_col).cast("string").alias(OWN + "text")).withColumn(OWN + "hash", F.xxhash64(OWN + "text"))
    ranged = read.repartitionByRange(n, OWN + "id", OWN + "hash").sortWithinPartitions(OWN + "id", OWN + "hash", OWN + "text").drop(OWN + "hash")
    return sorted(ranged.mapInArrow(run, MANIFEST).collect())


def read_tokens(spark, manifest: list, frame_ids: int = FRAME_IDS) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens and ids_crc32, checksums verified."""
    ship(spark)
    starts, total = [], 0
    for row in manifest:
        starts.append((row["shard"], row["path"], total))
        total += row["n_tokens"]
    files = spark.createDataFrame(starts or [(0, None, 0)], "shard long, path string, first long")
    files = files.filter("path is not null").repartition(max(1, len(starts)), "shard") if len(starts) > 1 else files.filter("path is not null")

    def run(batches):
        for batch in batches:
            for path, first in rows_of(batch, "path", "first"):
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    reader = StoreReader(source, frame_ids)
                    crcs = []
                    for k in range(len(reader)):
                        crc = 0
                        for chunk in reader.document(k):
                            crc = zlib.crc32(chunk, crc)
                        crcs.append(crc)
                begin = first + np.concatenate([[0], np.cumsum(reader.counts)])[:-1]
                ids = pa.array([reader.doc_id(k) for k in range(len(reader))], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin, pa.int64()), pa.array(reader.counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, RESULT)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode, write, and read back: doc_id, start, n_tokens and ids_crc32 of each document.

    A null text counts as empty and is its end id alone.  Null identifiers come first; equal ones are
    ordered by their texts' hash and then their texts, one row of the result each.  An empty table
    writes no file and gives an empty result.  Further columns are not read.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    return read_tokens(spark, write_tokens(docs, path, tokenizer, end_id, id_col, text_col))
