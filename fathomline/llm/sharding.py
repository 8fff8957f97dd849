"""Sharding by extendible hashing.

A document's hash bits are the leading bits of md5 of its identifier as text.  The directory starts
with one bucket; only a bucket over the byte limit is split on one more bit, until every bucket fits.
Bytes are summed per prefix some bits deeper than the depth that even data would need, and from those
sums for each shorter prefix; a prefix's shard is its shortest beginning that fits.  So one pass over
the documents settles nearly all buckets; what is still too large there is summed deeper in another
pass, over its documents only.  The directory has some sixteen entries a shard; it is a table that
executors make and that documents are joined with, and no part of it comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .common import OWN

#: Bits of the hash that are used at most; 52 fit a double and any SQL integer.
BITS = 52
EXTRA = 4
LEAF = "struct<depth:int,prefix:long,n_bytes:long,n_docs:long>"


def hash_bits(identifier: Column) -> Column:
    """The leading 52 bits of md5 of the identifier as text, as a number; null counts as empty."""
    text = F.coalesce(identifier.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def entries(sized: DataFrame, top: int, depth: int, limit: int) -> tuple[DataFrame, bool]:
    """Of rows with bits and n_bytes: entry (a prefix of `depth` bits) and the leaf it belongs to.

    Buckets of `top` bits are known to be too large (0: none is known).  The leaf is null where a bucket
    of `depth` bits is too large still; whether there is such a one comes second.
    """
    sums = sized.groupBy(prefix(F.col("bits"), depth).alias("entry")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    sums = materialise(sums, "shard-sums")
    first = top + 1 if top else 0
    levels = F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth")
    above = lambda: F.call_function("shiftright", F.col("entry"), F.lit(depth) - F.col("depth"))
    each = sums.select("entry", "b", "n", levels).withColumn("prefix", above())
    buckets = each.groupBy("depth", "prefix").agg(F.sum("b").alias("n_bytes"), F.sum("n").alias("n_docs"))
    fitting = buckets.filter((F.col("n_bytes") <= limit) | (F.col("n_docs") == 1) | (F.col("depth") == BITS))
    leaves = each.select("entry", "depth", "prefix").join(fitting, ["depth", "prefix"]).groupBy("entry").agg(F.min(F.struct("depth", "prefix", "n_bytes", "n_docs")).alias("leaf"))
    found = materialise(sums.select("entry").join(leaves, "entry", "left"), "shard-entries")
    return found, not found.filter(F.col("leaf").isNull()).isEmpty()


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """(depth, entries of that depth) for rows with bits and n_bytes, each deeper than the one before."""
    total = sized.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return []
    out, top, rows, more = [], 0, sized, True
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + EXTRA)
    while more:
        found, more = entries(rows, top, depth, limit)
        out.append((depth, found))
        if more:
            large = found.filter(F.col("leaf").isNull()).select("entry")
            rows = rows.join(large, prefix(F.col("bits"), depth) == F.col("entry"), "left_semi")
            top, depth = depth, min(BITS, depth + EXTRA)
    return out


def shard_documents(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard (the bits of its prefix as 0 and 1), shard_depth, shard_bytes and shard_docs.

    Bytes are those of the text in UTF-8.  A document larger than the limit stands alone in a shard
    over it; so do rows that repeat one identifier, which no hash bit can part.  Null texts have no
    bytes; null identifiers hash as empty text.  An empty table gives an empty result.  Columns of docs
    with a result's name are replaced.
    """
    names = ("shard", "shard_depth", "shard_bytes", "shard_docs")
    docs = docs.drop(*[c for c in names if c in docs.columns])
    bits = hash_bits(F.col(id_col))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    joined = docs.withColumn(OWN + "bits", bits)
    leaf = F.lit(None).cast(LEAF)
    for k, (depth, found) in enumerate(directory(docs.select(bits.alias("bits"), size.alias("n_bytes")), limit)):
        # Spark broadcasts entries only where they are small
        found = found.filter(F.col("leaf").isNotNull()).select(F.col("entry").alias(f"{OWN}e{k}"), F.col("leaf").alias(f"{OWN}l{k}"))
        joined = joined.join(found, prefix(F.col(OWN + "bits"), depth) == F.col(f"{OWN}e{k}"), "left")
        leaf = F.coalesce(leaf, F.col(f"{OWN}l{k}"))
    joined = joined.withColumn(OWN + "leaf", leaf)
    depth, at = F.col(OWN + "leaf.depth"), F.col(OWN + "leaf.prefix")
    shown = F.when(depth == 0, F.lit("")).otherwise(F.expr(f"lpad(bin({OWN}leaf.prefix), {OWN}leaf.depth, '0')"))
    return joined.select(*docs.columns, F.when(at.isNotNull(), shown).alias("shard"), depth.alias("shard_depth"), F.col(OWN + "leaf.n_bytes").alias("shard_bytes"), F.col(OWN + "leaf.n_docs").alias("shard_docs"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, shard=<bits>, each written by the task that its documents are dealt to."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
