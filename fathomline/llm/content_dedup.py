"""Exact dedup by content sort, with DataFrame operations only.

Normalised texts are dealt to ranges of their own leading characters, whose splitters Spark samples;
each range is sorted externally by the whole text, so equal texts stand next to each other, and the
window operator compares each whole text with its neighbour.  The range key is the text's first PREFIX
characters, so the sampled splitters stay small however long texts are; among texts that begin alike
for longer, a hash goes on where the characters end.  Equal texts have equal keys, so no group is cut
by a splitter.  Whole texts go through that one exchange, and its order is the one that the window needs.

A text whose copies would fill more than half an average range is hot.  There are at most twice as
many hot texts as ranges.  Their rows get a salt, which cuts the group over several ranges, and the
groups' totals come from an aggregation that collapses copies before its shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import shuffle_partitions
from .common import OWN, number_table

P, H, S, T, SHA = (OWN + x for x in ("prefix", "hash", "salt", "text", "sha"))
#: Characters of a text by which ranges are cut.
PREFIX = 64


def hot_hashes(hashes: DataFrame, least: int) -> list[tuple[int, int]]:
    """(hash, rows) of the values in more than `least` rows: at most rows / least of them."""
    counts = hashes.groupBy(H).count().filter(F.col("count") > least)
    return [(r[0], r[1]) for r in counts.collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=None, partitions: int | None = None) -> DataFrame:
    """All rows and columns of docs plus keep_id, group_size, kept and text_sha256.

    keep: "largest" or "smallest" identifier of a group of equal texts stays.  normalise: a function
    from Column to Column applied to texts before comparison (none: as they are).

    Null texts count as empty.  Null identifiers lose against any other; where all of a group are
    null, one row stays and keep_id is null.  Of rows that repeat an identifier and its text one stays.
    Columns of docs with a result's name are replaced.  An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    n = partitions or shuffle_partitions(docs.sparkSession)
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    docs = docs.drop(*[c for c in ("keep_id", "group_size", "kept", "text_sha256") if c in docs.columns and c not in (id_col, text_col)])
    hashed = docs.withColumn(T, text).withColumn(H, F.xxhash64(T))
    least = max(32, math.ceil(docs.count() / (2 * n)))
    hot = hot_hashes(hashed.select(H), least)
    best = F.max if keep == "largest" else F.min
    key = [P, H]
    if hot:
        # at most 2 n texts.  Rows without identifier are dealt by the task that reads them
        cuts = number_table(docs.sparkSession, [(h, math.ceil(c / least)) for h, c in hot], H, OWN + "cuts")
        dealt = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.spark_partition_id())
        salt = F.pmod(dealt, F.col(OWN + "cuts"))
        hashed = hashed.join(F.broadcast(cuts), H, "left").withColumn(S, F.coalesce(salt, F.lit(0).cast("long")))
        key.append(S)
    ranged = hashed.withColumn(P, F.substring(T, 1, PREFIX)).repartitionByRange(n, *key)
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    same = Window.partitionBy(*key, T)
    nth = same.orderBy(order)
    out = ranged.withColumn("keep_id", F.first(id_col).over(nth)).withColumn(OWN + "nth", F.row_number().over(nth)).withColumn("group_size", F.count(F.lit(1)).over(same)).withColumn("text_sha256", F.sha2(F.col(T).cast("binary"), 256))
    first = F.col(OWN + "nth") == 1
    if hot:
        salted = hashed.filter(F.col(OWN + "cuts").isNotNull())
        # where no row of a group has an identifier, one in the least salt stays
        totals = salted.groupBy(T).agg(best(id_col).alias(OWN + "keep"), F.count(F.lit(1)).alias(OWN + "size"), F.min(F.when(F.col(id_col).isNull(), F.col(S))).alias(OWN + "least"))
        totals = totals.select(F.sha2(F.col(T).cast("binary"), 256).alias(SHA), OWN + "keep", OWN + "size", OWN + "least")
        hot_row = F.col(SHA).isNotNull()
        out = out.join(F.broadcast(totals), F.col("text_sha256") == F.col(SHA), "left").withColumn("keep_id", F.when(hot_row, F.col(OWN + "keep")).otherwise(F.col("keep_id"))).withColumn("group_size", F.when(hot_row, F.col(OWN + "size")).otherwise(F.col("group_size")))
        first = first & (~hot_row | F.col(id_col).isNotNull() | (F.col(S) == F.col(OWN + "least")))
    out = out.withColumn("kept", first & F.col(id_col).eqNullSafe(F.col("keep_id")))
    return out.select(*docs.columns, "keep_id", "group_size", "kept", "text_sha256")
