"""Neighbour statistics of points: k-th neighbours by stripes, margins counted from ranks.

Points of a key are ranked along an axis by a distributed sort and dealt into stripes of about the root of their
number.  A point's k nearest within its own stripe bound the radius in which its true ones lie; it then asks only
the stripes that this radius reaches, as a join on the stripe, and the nearest of all answers are exact.
Counts within a distance along one axis are differences of two positions, each found in the stripe it falls in.  So
no task has more than a stripe and the points that ask it, and no pairs are written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import digamma
from ..runtime import materialise, ship

#: Points of a stripe at least, rows of so many distances that are held at a time, and points of a first window.
LEAST_STRIPE, BLOCK, WINDOW = 256, 256, 64
#: Factors of row numbers that make the jitter which breaks ties, and its share of the standard deviation.
JITTER = {"x": 2654435761, "y": 2246822519}
JITTER_SHARE = 1e-10
#: Radii are taken this much smaller, so that the k-th neighbour itself isn't counted.
INNER = 1 - 1e-10


def ranked(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """df with rank, from 0 within each key in the given order: a sort by ranges, then the ranges' counts are added
    up in a table with a row per key and range."""
    at = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    at = materialise(at.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), label)
    parts = at.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(parts, [key, "_part"]).withColumn("rank", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")


class Stripes:
    """Stripes of points (key, id, x, y, n) along an axis: a table of the points, and the stripes' bounds by key.

    The bounds are as many as the root of the points, and are sent to the tasks.
    """

    def __init__(self, points: DataFrame, axis: str, k: int, least: int):
        spark = points.sparkSession
        size = F.greatest(F.lit(least), F.ceil(F.sqrt(F.lit(k) * F.col("n"))))
        number = F.greatest(F.lit(1), F.floor(F.col("n") / size))
        dealt = ranked(points, "key", [axis, "id"], f"stripes-{axis}").withColumn("stripe", F.floor(F.col("rank") * number / F.col("n")).cast("long"))
        self.axis, self.points = axis, materialise(dealt.select("key", "stripe", "id", "x", "y", "rank", "n"), f"striped-{axis}")
        bounds: dict = {}
        for r in self.points.groupBy("key", "stripe").agg(F.min(axis).alias("low"), F.max(axis).alias("high"), F.min("rank").alias("first")).orderBy("key", "stripe").collect():
            bounds.setdefault(r["key"], []).append((r["low"], r["high"], r["first"]))
        self.bounds = spark.sparkContext.broadcast({g: np.array(b) for g, b in bounds.items()})


def jittered(pairs: DataFrame, x: str, y: str, key: str, row: str) -> DataFrame:
    """key, id, x, y, n of the rows whose values are known; ties are broken by a jitter made of the row's number.

    The jitter is a fixed function of `row` (whole numbers), so a result doesn't depend on how rows lie.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = pairs.filter(F.col(key).isNotNull() & known(x) & known(y)).select(F.col(key).alias("key"), F.col(row).cast("long").alias("row"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    scale = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s" + c)
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), scale("x"), scale("y"))
    noise = lambda c: (F.pmod(F.pmod("row", F.lit(1 << 31)) * F.lit(JITTER[c]), F.lit(1 << 32)) / float(1 << 32) - 0.5) * F.col("s" + c) * JITTER_SHARE
    return rows.join(stats, "key").select("key", F.monotonically_increasing_id().alias("id"), *((F.col(c) + noise(c)).alias(c) for c in ("x", "y")), "n")


def _nearest(ax, ay, bx, by, k: int, own: bool) -> np.ndarray:
    """The k least distances (greater of both axes) from each a to the b's, ascending; own: a's are the b's.

    Each a meets a window of b's around it in order of y.  Where the next b on either side may be nearer than the
    last of those found, the a meets a window of four times that width, up to all.
    """
    k = min(k + own, len(bx))
    order = np.argsort(by, kind="stable")
    bx, by = bx[order], by[order]
    out = np.empty((len(ax), k))
    left, width = np.arange(len(ax)), WINDOW
    place = np.searchsorted(by, ay)
    while len(left):
        size = min(max(width, k), len(by))
        again = []
        rows = max(1, BLOCK * LEAST_STRIPE // size)
        for at in (left[i : i + rows] for i in range(0, len(left), rows)):
            first = np.clip(place[at] - size // 2, 0, len(by) - size)
            window = first[:, None] + np.arange(size)
            d = np.maximum(np.abs(ax[at, None] - bx[window]), np.abs(ay[at, None] - by[window]))
            if k < size:
                d = np.partition(d, k - 1, axis=1)[:, :k]
            out[at] = d = np.sort(d, axis=1)
            below = np.where(first > 0, np.abs(ay[at] - by[np.maximum(first - 1, 0)]), np.inf)
            above = np.where(first + size < len(by), np.abs(ay[at] - by[np.minimum(first + size, len(by) - 1)]), np.inf)
            again.append(at[np.minimum(below, above) < d[:, -1]])
        left, width = np.concatenate(again), 4 * width
    return out[:, int(own) :]  # a point's distance to itself comes first


NEAR = "key string, id long, x double, y double, stripe long, near array<double>"


def neighbour_radii(stripes: Stripes, k: int) -> DataFrame:
    """key, id, x, y, radius: the distance to the k-th neighbour, or the last where a key has fewer."""
    bounds = stripes.bounds

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        return rows[["key", "id", "x", "y", "stripe"]].assign(near=list(_nearest(x, y, x, y, k, True)))

    def reach(batches):
        for rows in batches:
            out = []
            for key, part in rows.groupby("key"):
                b = bounds.value[key]
                x = part["x"].to_numpy()
                r = np.array([v[k - 1] if len(v) >= k else np.inf for v in part["near"]]) * (1 + 1e-9)
                first, last = np.searchsorted(b[:, 1], x - r), np.searchsorted(b[:, 0], x + r, "right") - 1
                n = np.maximum(last - first + 1, 0)
                at = np.repeat(np.arange(len(part)), n)
                target = np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                asked = part.iloc[at][["key", "id", "x", "y", "stripe"]].assign(target=target)
                out.append(asked[asked["target"] != asked["stripe"]].drop(columns="stripe"))
            if out:
                yield pd.concat(out)

    def answer(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or points.empty:
            return asked[["key", "id"]].head(0).assign(near=pd.Series([], dtype=object))
        found = _nearest(asked["x"].to_numpy(), asked["y"].to_numpy(), points["x"].to_numpy(), points["y"].to_numpy(), k, False)
        return asked[["key", "id"]].assign(near=list(found))

    own = materialise(stripes.points.groupBy("key", "stripe").applyInPandas(inside, NEAR), "own-neighbours")
    asked = own.mapInPandas(reach, "key string, id long, x double, y double, target long")
    far = stripes.points.groupBy("key", "stripe").cogroup(asked.groupBy("key", "target")).applyInPandas(answer, "key string, id long, near array<double>")
    # a point's answers: k from each stripe it asked
    near = own.select("key", "id", "near").union(far).groupBy("key", "id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return own.select("key", "id", "x", "y").join(near, ["key", "id"]).select("key", "id", "x", "y", F.element_at("near", F.least(F.lit(k), F.size("near"))).alias("radius"))


def counts_within(asked: DataFrame, stripes: Stripes, value: str) -> DataFrame:
    """key, id, count: the points whose coordinate on the stripes' axis differs from `value` by `radius` or less."""
    bounds, axis = stripes.bounds, stripes.axis

    def ends(batches):
        for rows in batches:
            out = []
            for key, part in rows.groupby("key"):
                b = bounds.value[key]
                v, r = part["v"].to_numpy(), part["radius"].to_numpy()
                up = np.clip(np.searchsorted(b[:, 0], v + r, "right") - 1, 0, None)
                down = np.clip(np.searchsorted(b[:, 1], v - r), None, len(b) - 1)
                out += [part.assign(target=up, side=1), part.assign(target=down, side=-1)]
            if out:
                yield pd.concat(out)

    def position(points: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or points.empty:
            return rows[["key", "id"]].head(0).assign(count=0)
        z = np.sort(points[axis].to_numpy())
        v, r, side = rows["v"].to_numpy(), rows["radius"].to_numpy(), rows["side"].to_numpy()
        # points up to the end are those whose difference, as it is computed, is within the radius
        at = np.where(side > 0, np.searchsorted(z, v + r, "right"), np.searchsorted(z, v - r))
        while True:
            below, above = z[np.maximum(at - 1, 0)], z[np.minimum(at, len(z) - 1)]
            back = (at > 0) & np.where(side > 0, below - v > r, v - below <= r)
            on = (at < len(z)) & np.where(side > 0, above - v <= r, v - above > r) & ~back
            if not (back.any() or on.any()):
                break
            at = at - back + on
        return rows[["key", "id"]].assign(count=side * (at + int(points["rank"].min())))

    edges = asked.select("key", "id", F.col(value).alias("v"), "radius").mapInPandas(ends, "key string, id long, v double, radius double, target long, side int")
    found = stripes.points.groupBy("key", "stripe").cogroup(edges.groupBy("key", "target")).applyInPandas(position, "key string, id long, count long")
    return found.groupBy("key", "id").agg(F.sum("count").alias("count"))


def ksg_information(pairs: DataFrame, x: str, y: str, key: str = "symbol", row: str = "seq", k: int = 4, least_stripe: int | None = None) -> DataFrame:
    """key and ksg: mutual information in nats from k-th neighbour distances (greater of both axes).

    Rows without a key or with a value that is null or no finite number are left out; keys of a single row have 0.
    """
    ship(pairs.sparkSession)
    least = max(k + 1, least_stripe or LEAST_STRIPE)
    points = materialise(jittered(pairs, x, y, key, row).withColumn("key", F.col("key").cast("string")), "points")
    several = points.filter("n > 1")
    by_x, by_y = Stripes(several, "x", k, least), Stripes(several, "y", k, least)
    radii = materialise(neighbour_radii(by_x, k).withColumn("radius", F.col("radius") * INNER), "radii")
    both = counts_within(radii, by_x, "x").withColumnRenamed("count", "nx").join(counts_within(radii, by_y, "y").withColumnRenamed("count", "ny"), ["key", "id"])

    def psi(batches):
        for rows in batches:
            # the point itself is no neighbour
            yield rows[["key"]].assign(psi=digamma(np.maximum(rows["nx"].to_numpy() - 1, 0) + 1.0) + digamma(np.maximum(rows["ny"].to_numpy() - 1, 0) + 1.0))

    total = both.mapInPandas(psi, "key string, psi double").groupBy("key").agg(F.avg("psi").alias("psi"))
    sizes = points.groupBy("key").agg(F.max("n").alias("n"))

    def result(batches):
        for rows in batches:
            n = rows["n"].to_numpy(float)
            value = digamma(np.minimum(float(k), np.maximum(n - 1, 1))) + digamma(n) - rows["psi"].to_numpy(float)
            yield pd.DataFrame({key: rows["key"], "ksg": np.where(n > 1, value, 0.0)})

    return sizes.join(total, "key", "left").mapInPandas(result, f"{key} string, ksg double")
