"""Near-duplicate documents by min-max hashing, with links confirmed on full sets.

A document's set of shingles is hashed once per permutation; both the least and the greatest value are
kept, so 64 permutations give 128 signature values.  A band is the minima and maxima of two
permutations, and 32 bands miss a pair of similarity 0.8 less than once in ten million.

Equal sets are one class from the start, whose smallest identifier stands for it, so copies cost
nothing further.  An identifier that stands for several texts is a node per text, and an edge joins the
classes of its texts.  Links between classes are found in three rounds, each of which compares members of
band buckets by signature, confirms those that may be similar enough on full sets, and merges:
  1. each member with the smallest member of its bucket;
  2. each member with a member picked by hash, another one in each band, where labels still differ;
  3. all pairs of a bucket whose labels still differ, in blocks of bounded size, compared where they stand.
After the third round each candidate pair is either in one component or has been compared itself, so no
link between different sets is lost, and a bucket of n copies costs n comparisons and not n * n.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_path, materialise, scratch_path, ship, small_batches
from .common import worker_table
from .tokens import rows_of

PERMUTATIONS, BANDS = 64, 32
#: Signature agreement below which a pair of similarity 0.8 is found less than once in a million.
FILTER_SIGMAS = 5.0
#: Members and shingles of a block, on average; a bucket over either is compared block by block.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
MOST_WORDS = 200_000
#: Nodes that a task contracts before it passes its stars on.
MOST_NODES = 1_000_000



def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the permutations x -> (x ^ offset) * factor of 64-bit numbers."""
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Scratch:
    """Tables in the shared folder that are dropped when they are done with."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
        """tasks: write by so few tasks, for tables whose size is known to be small."""
        path = scratch_path(self.spark, f"near-dup-{label}")
        (df.coalesce(tasks) if tasks else df).write.parquet(path)
        self.paths.append((label, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Tables of these labels, or all."""
        gone = [p for p in self.paths if not labels or p[0] in labels]
        for _, path in gone:
            drop_path(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS:
            self[word] = h
        return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = worker_table("near-dup words", _Hashes)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        x = _mix(x ^ h[k : len(h) - n + 1 + k]) + np.uint64(k + 1)
    return np.unique(x)


def min_max(sets: list[np.ndarray], factors: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of each set (none is empty) under each permutation: two arrays sets x permutations."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = np.concatenate(sets)
    low = np.empty((len(sets), len(factors)), np.uint64)
    high = np.empty_like(low)
    for j in range(len(factors)):
        h = (x ^ offsets[j]) * factors[j]
        low[:, j] = np.minimum.reduceat(h, starts)
        high[:, j] = np.maximum.reduceat(h, starts)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band: minima and maxima of the permutations dealt to it."""
    per = low.shape[1] // bands
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(low), bands))
    for k in range(per):
        key = _mix(key ^ low[:, k::per]) * np.uint64(3)
        key = _mix(key ^ high[:, k::per]) * np.uint64(5)
    return key.view(np.int64)


def signatures(texts: DataFrame, width: int, permutations: int, bands: int) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, key (of the whole set), sig (a byte per value) and bands."""
    ship(texts.sparkSession)

    def run(batches):
        factors, offsets = multipliers(permutations)
        for batch in batches:
            held, size = [], 0
            for doc, node, text in rows_of(batch, "doc_id", "hash", "text"):
                held.append((doc, node, s := shingle_set(text, width)))
                size += len(s)
                if size > 1 << 18:
                    yield out(held, factors, offsets)
                    held, size = [], 0
            if held:
                yield out(held, factors, offsets)

    def out(held, factors, offsets):
        full = [s for *_, s in held if len(s)]
        at = iter(range(len(full)))
        if full:
            low, high = min_max(full, factors, offsets)
            keys = band_keys(low, high, bands)
            sig = np.hstack([_mix(low), _mix(high)]).astype(np.uint8)
        place = [next(at) if len(s) else None for *_, s in held]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in held], pa.int64()),
                pa.array([n for _, n, _ in held], pa.int64()),
                pa.array([len(s) for *_, s in held], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for *_, s in held], pa.binary()),
                pa.array([None if p is None else sig[p].tobytes() for p in place], pa.binary()),
                pa.array([None if p is None else keys[p] for p in place], pa.list_(pa.int64())),
            ],
            ["doc_id", "hash", "n_shingles", "key", "sig", "bands"],
        )

    return texts.select("doc_id", "hash", "text").mapInArrow(run, "doc_id long, hash long, n_shingles long, key binary, sig binary, bands array<long>")


def _least_agreement(threshold: float, values: int) -> int:
    return max(0, int(values * threshold - FILTER_SIGMAS * (values * threshold * (1 - threshold)) ** 0.5))


def may_link(n_a, n_b, sig_a: np.ndarray, sig_b: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Whether sizes allow the similarity and enough signature values agree."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & ((sig_a == sig_b).sum(-1) >= least)


def filter_pairs(pairs: DataFrame, nodes: DataFrame, percent: int, values: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    least = _least_agreement(percent / 100, values)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias("n_" + c), F.col("sig").alias("sig_" + c))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = [batch.column("n_" + c).to_numpy() for c in "ab"]
            s = [np.frombuffer(b"".join(batch.column("sig_" + c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "ab"]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(may_link(*n, *s, percent, least)))

    return both.mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, ids: DataFrame, width: int, repeated: bool, short: bool = False) -> DataFrame:
    """node, set of the nodes in ids: an array of hashes, or as short 32-bit hashes in one binary.

    repeated: rows of texts may repeat a node, which then still has one set.
    """
    read = texts.select("node", "text").join(ids, "node", "left_semi")

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for doc, text in rows_of(batch, "node", "text"):
                held.append((doc, s := shingle_set(text, width)))
                size += len(s)
                if size > 1 << 20:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    def out(held):
        if short:
            sets = pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for _, s in held], pa.binary())
        else:
            sets = pa.array([s.view(np.int64) for _, s in held], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), sets], ["node", "set"])

    sets = read.mapInArrow(run, "node long, set " + ("binary" if short else "array<long>"))
    return sets.dropDuplicates(["node"]) if repeated else sets


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, repeated: bool, scratch: Scratch) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = scratch.write(_sets(texts, ids, width, repeated), "sets")
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return joined.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _stars(batches):
    """Edges of one task contracted by union-find: (root, node) with the smallest node as root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = y
        return x

    def out():
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["root", "node"])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        if len(up) > MOST_NODES:
            yield out()
            up = {}
    if up:
        yield out()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node reachable, for the nodes of the edges (a, b).

    Each task contracts its own edges to stars; a node that several tasks saw links their roots.  Those
    links between roots, far fewer than the edges, are contracted in the same way until none are left.
    A node has at most one root per task and flush, however many links it has.
    """
    stars = edges.select("a", "b").mapInArrow(_stars, "root long, node long")
    found = scratch.write(stars.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots")), "components")
    assigned = found.select("node", F.get("roots", F.lit(0)).alias("label"))
    between = found.filter(F.size("roots") > 1).select(F.get("roots", F.lit(0)).alias("a"), F.explode(F.slice("roots", 2, F.size("roots"))).alias("b"))
    if between.isEmpty():
        return assigned
    above = components(between, scratch).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return assigned.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def _labelled(band_rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return band_rows.withColumn("label", F.col("node"))
    return band_rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_buckets(rows: DataFrame, least: int) -> DataFrame:
    """Buckets of `least` members or more that have more than one label."""
    stats = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("node").alias("first"), F.min(F.struct(F.xxhash64("bucket", "node"), "node"))["node"].alias("picked"))
    return stats.filter((F.col("low") < F.col("high")) & (F.col("members") >= least)).select("bucket", "members", "shingles", "first", "picked")


def _remaining_links(rows: DataFrame, percent: int, values: int) -> DataFrame:
    """Pairs (a, b) to confirm within buckets of rows: bucket, members, shingles, node, label, n, sig, set.

    Buckets over BLOCK members or BLOCK_SHINGLES shingles are compared block by block.  Members with different labels whose
    signatures agree are compared on sets of 32-bit hashes where they stand; those clearly over the
    threshold are merged at once, so a pair is given for each merge, besides those on the edge of it.
    """
    least = _least_agreement(percent / 100, values)
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).select("bucket", "node", "label", "n", "sig", "set", F.explode(ends).alias("pair"))

    def run(table: pa.Table) -> pa.Table:
        node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        names, code = np.unique(label, return_inverse=True)
        code = code.copy()
        if len(names) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(v, np.uint32) for v in table.column("set").to_pylist()]
        common = np.bincount(code).argmax()
        a, b = [], []
        for k in np.flatnonzero(code != common):
            hits = np.flatnonzero(code != code[k])
            hits = hits[may_link(n[k], n[hits], sig[k], sig[hits], percent, least)]
            for h in hits:
                if code[h] == code[k]:
                    continue
                shared = len(np.intersect1d(sets[k], sets[h], assume_unique=True))
                ratio = 100 * shared / (len(sets[k]) + len(sets[h]) - shared)
                if ratio >= percent - 1:
                    a.append(min(node[k], node[h]))
                    b.append(max(node[k], node[h]))
                if ratio >= percent + 1:
                    code[code == code[h]] = code[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "pair.i", "pair.j").applyInArrow(run, "a long, b long").distinct()


def with_nodes(signed: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, bool, bool]:
    """signed and texts with their nodes, the identifiers that stand for several texts, and whether there are
    any such and any repeated rows.

    A row's node is its identifier; only where the identifier has several texts, it is a hash of both.
    """
    seen = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count(F.lit(1)).alias("rows"))
    found = scratch.write(seen.filter("rows > 1"), "repeated-ids")
    repeated, several = not found.isEmpty(), found.filter("low < high").select("doc_id")
    some = repeated and not several.isEmpty()

    def noded(df: DataFrame) -> DataFrame:
        if not some:
            return df.withColumn("node", F.col("doc_id"))
        marked = df.join(several.withColumn("several", F.lit(True)), "doc_id", "left")
        return marked.withColumn("node", F.when(F.col("several"), F.xxhash64("doc_id", "hash")).otherwise(F.col("doc_id"))).drop("several")

    return noded(signed), noded(texts), several, some, repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Words are runs of other than ASCII white space with A-Z lower-cased; documents link whose sets of
    `width`-word shingles have a Jaccard similarity of `percent` hundredths or more.  component_id is
    the smallest identifier reachable by links.

    A document without words or with a null text has no shingles and links with nothing.  A row with a
    null identifier links with nothing, has a null component and is kept.  Rows that repeat an identifier
    are one document with several texts: it links where any of them does, and its rows have one
    component and are kept or go together.  An empty table gives an empty result.  Further columns are
    not read.
    """
    values = 2 * permutations
    spark = docs.sparkSession
    scratch = Scratch(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    with small_batches(spark):
        signed = scratch.write(signatures(read, width, permutations, bands), "signatures")
    signed, texts, several, some, repeated = with_nodes(signed, read, scratch)
    usable = signed.filter(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    classes = scratch.write(usable.groupBy("key").agg(F.min("node").alias("class"), F.min("doc_id").alias("least")), "classes")
    found = usable.select("key", "node", F.col("n_shingles").alias("n"), "sig", "bands")
    nodes = found.join(classes.select("key", F.col("class").alias("node")), ["key", "node"], "left_semi")
    # rows that repeat an identifier and its text are one node
    nodes = scratch.write((nodes.dropDuplicates(["key", "node"]) if repeated else nodes).drop("key"), "nodes")
    band_rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    edges, labels, own = None, None, None
    if some:
        # the edges that an identifier makes between the classes of its texts
        own = scratch.write(usable.join(several, "doc_id", "left_semi").join(classes, "key").select("doc_id", F.col("class").alias("b")).distinct(), "own")
        shared = scratch.write(own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a < b").select("a", "b"), "shared")
        if not shared.isEmpty():
            edges, labels = shared, components(shared, scratch)
    for step in (1, 2, 3):
        rows = _labelled(band_rows, labels)
        opened = scratch.write(_open_buckets(rows, 2 if step < 2 else 3), "buckets")
        if step > 1 and opened.isEmpty():
            break
        members = rows.join(opened, "bucket")
        if step < 3:
            pivot = "first" if step == 1 else "picked"
            pairs = members.filter(F.col("node") != F.col(pivot))
            if step == 2:
                pivots = (labels if labels is not None else nodes.select("node", F.col("node").alias("label"))).select(F.col("node").alias("picked"), F.col("label").alias("own"))
                pairs = pairs.join(pivots, "picked", "left").filter(F.coalesce("own", "picked") != F.col("label"))
            pairs = pairs.select(F.least("node", pivot).alias("a"), F.greatest("node", pivot).alias("b")).distinct()
            pairs = filter_pairs(pairs, nodes, percent, values)
        else:
            sets = scratch.write(_sets(texts, members.select("node").distinct(), width, repeated, short=True), "short-sets")
            pairs = _remaining_links(members.join(nodes.select("node", "sig"), "node").join(sets, "node"), percent, values)
        pairs = scratch.write(pairs, "pairs")
        scratch.drop("buckets", "short-sets")
        if pairs.isEmpty():
            continue
        linked = scratch.write(confirm(pairs, texts, width, percent, repeated, scratch), "links")
        scratch.drop("sets", "pairs")
        if linked.isEmpty():
            continue
        edges = linked if edges is None else edges.union(linked)
        labels = components(edges, scratch)
    top = F.col("least")
    if labels is not None:
        # a component is named after the least identifier of its classes
        linked = classes.join(labels.withColumnRenamed("node", "class"), "class")
        tops = linked.join(linked.groupBy("label").agg(F.min("least").alias("top")), "label").select("key", "top")
        classes, top = classes.join(tops, "key", "left"), F.coalesce("top", "least")
    out = signed.select("doc_id", "n_shingles", "key").join(classes.select("key", "class", top.alias("top")), "key", "left")
    component = F.coalesce("top", "doc_id")
    if some:
        # a row without words has the component of its identifier's other texts
        by_id = own.join(classes.select(F.col("class").alias("b"), top.alias("of_id")), "b").groupBy("doc_id").agg(F.min("of_id").alias("of_id"))
        out, component = out.join(by_id, "doc_id", "left"), F.coalesce("top", "of_id", "doc_id")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    out = materialise(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near-dup-result")
    scratch.drop()
    return out
