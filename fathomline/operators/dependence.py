"""Dependence and distance: histograms and sums in SQL, neighbour statistics in blocked numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import digamma, sums_below
from ..runtime import materialise, ship
from .neighbours import ranked


def number_of_bins(n: int, correlation: float | None = None) -> int:
    if correlation is None:
        z = (8 + 324 * n + 12 * math.sqrt(36 * n + 729 * n * n)) ** (1 / 3)
        return round(z / 6 + 2 / (3 * z) + 1 / 3)
    rest = max(1 - correlation**2, 1e-10 * (2 - 1e-10)) if abs(abs(correlation) - 1) < 1.5e-8 else 1 - correlation**2
    return round(2**-0.5 * math.sqrt(1 + math.sqrt(1 + 24 * n / rest)))


def bins_of(n: Column, correlation: Column) -> Column:
    """number_of_bins of a pair as a Column."""
    rest = 1 - correlation * correlation
    least = F.when(F.abs(F.abs(correlation) - 1) < 1.5e-8, F.greatest(rest, F.lit(1e-10 * (2 - 1e-10)))).otherwise(rest)
    return F.rint(2**-0.5 * F.sqrt(1 + F.sqrt(1 + F.try_divide(24 * n, least)))).cast("long")


def bin_of(x: str, low: str, high: str, bins: str) -> Column:
    """Equal-width bins from 1 between columns low and high, as many as column bins says; the last is closed, and a
    constant is bin 1."""
    lo, hi = F.col(low), F.col(high)
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(F.floor(F.try_divide(F.col(x) - lo, hi - lo) * F.col(bins)) + 1, F.col(bins)))


def information(pairs: DataFrame, x: str, y: str, bins: int | None, key: str = "symbol") -> DataFrame:
    """key, bins, h_x, h_y, mi in nats of the two-way histogram, and variation of information, plain and normed.

    bins: None for each key's own number, from its rows and their correlation (a side without deviation has none: 0).

    Ranges are aggregated and joined back, and rows are counted by cell where they lie, so no key's rows meet in a
    task.  Rows without a key or with an unknown value are left out.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = pairs.filter(F.col(key).isNotNull() & known(x) & known(y)).select(key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ends = rows.groupBy(key).agg(*(f(c).alias(c + n) for c in ("_x", "_y") for f, n in ((F.min, "_low"), (F.max, "_high"))), F.count(F.lit(1)).cast("double").alias("_n"), F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("_r"))
    r = F.greatest(F.least(F.coalesce("_r", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    ends = ends.withColumn("bins", bins_of(F.col("_n"), r) if bins is None else F.lit(bins).cast("long"))
    cells = rows.join(ends, key).groupBy(key, "bins", bin_of("_x", "_x_low", "_x_high", "bins").alias("bx"), bin_of("_y", "_y_low", "_y_high", "bins").alias("by")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most bins * bins rows a key from here on
    g = lambda *c: F.sum("n").over(Window.partitionBy(key, *c))
    c = cells.withColumns({"nx": g("bx"), "ny": g("by"), "total": g()})
    p = F.col("n") / F.col("total")
    part = lambda m: -p * F.ln(F.col(m) / F.col("total"))  # noqa: E731  summed over cells this is the margin's entropy
    s = c.groupBy(key, "bins").agg(F.sum(part("nx")).alias("h_x"), F.sum(part("ny")).alias("h_y"), F.sum(part("n")).alias("h_xy"))
    s = s.withColumn("mi", F.col("h_x") + F.col("h_y") - F.col("h_xy"))
    s = s.withColumn("mi_norm", F.coalesce(F.try_divide("mi", F.least("h_x", "h_y")), F.lit(0.0)))
    s = s.withColumn("vi", F.col("h_x") + F.col("h_y") - 2 * F.col("mi"))
    return s.withColumn("vi_norm", F.coalesce(F.try_divide("vi", F.col("h_x") + F.col("h_y") - F.col("mi")), F.lit(0.0)))


def divergences(p: DataFrame, key: str = "symbol") -> DataFrame:
    """key, kl, cross_entropy of columns p and q, each scaled to 1 per key; infinite where q is 0 and p isn't."""
    w = Window.partitionBy(key)
    s = p.withColumn("_p", F.col("p") / F.sum("p").over(w)).withColumn("_q", F.col("q") / F.sum("q").over(w)).filter(F.col("_p") > 0)
    missing = F.max((F.col("_q") == 0).cast("int")) == 1
    inf = F.lit(float("inf"))
    return s.groupBy(key).agg(F.when(missing, inf).otherwise(F.sum(F.col("_p") * F.ln(F.try_divide(F.col("_p"), F.col("_q"))))).alias("kl"), F.when(missing, inf).otherwise(-F.sum(F.col("_p") * F.ln("_q"))).alias("cross_entropy"))


def correlation_distance(rho: Column, metric: str = "angular") -> Column:
    if metric not in ("angular", "absolute_angular", "squared_angular"):
        raise ValueError("metric is angular, absolute_angular or squared_angular")
    r = {"angular": rho, "absolute_angular": F.abs(rho), "squared_angular": rho * rho}[metric]
    return F.sqrt(F.rint((1 - r) * 1e6) / 1e6 / (2 if metric == "angular" else 1))


def ksg(x: np.ndarray, y: np.ndarray, k: int = 4, seed: int = 0, block: int = 512) -> float:
    """Mutual information in nats from k-th neighbour distances; blocks of rows bound the memory."""
    n = len(x)
    if n < 2:
        return 0.0
    k = min(k, n - 1)
    rng = np.random.default_rng(seed)
    x, y = (v + rng.standard_normal(n) * (v.std() or 1.0) * 1e-10 for v in (np.asarray(x, float), np.asarray(y, float)))
    total = 0.0
    for at in range(0, n, block):
        dx, dy = np.abs(x[at : at + block, None] - x), np.abs(y[at : at + block, None] - y)
        radius = np.partition(np.maximum(dx, dy), k, axis=1)[:, k] * (1 - 1e-10)
        nx, ny = ((d <= radius[:, None]).sum(1) - 1 for d in (dx, dy))
        total += float((digamma(np.maximum(nx, 0) + 1.0) + digamma(np.maximum(ny, 0) + 1.0)).sum())
    return float(digamma(float(k)) + digamma(float(n)) - total / n)


def _mean_distances(v: np.ndarray) -> np.ndarray:
    """Mean distance of each value to all values, from sums over the sorted values."""
    order = np.argsort(v, kind="stable")
    s, n = v[order], len(v)
    before = np.concatenate([[0.0], np.cumsum(s)[:-1]])
    out = np.empty(n)
    out[order] = (s * np.arange(n) - before + (s.sum() - before - s) - s * np.arange(n - 1, -1, -1)) / n
    return out


def _together(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all pairs of |x - x'| |y - y'| in n log n steps: in order of x, each value's sums over those before
    it are split into the ones of smaller y and the others."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    terms = np.stack([np.ones(len(x)), x, y, x * y])
    before = np.cumsum(terms, axis=1) - terms
    signed = lambda s: x * y * s[0] - x * s[2] - y * s[1] + s[3]  # noqa: E731  sum of (x - x')(y - y')
    return 2 * float((2 * signed(sums_below(y, terms)) - signed(before)).sum())


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """From sums over sorted values and merge counting: n log n, without any pair of values held."""
    x, y = (np.asarray(v, float) - np.mean(v) for v in (x, y))
    n = len(x)
    mx, my = _mean_distances(x), _mean_distances(y)
    covariance = _together(x, y) / n**2 - 2 * (mx * my).mean() + mx.mean() * my.mean()
    # the mean square of distances is twice the variance
    var = [2 * float((v * v).mean()) - 2 * (m * m).mean() + m.mean() ** 2 for v, m in ((x, mx), (y, my))]
    scale = math.sqrt(max(var[0], 0.0) * max(var[1], 0.0))
    return math.sqrt(max(covariance, 0.0) / scale) if scale > 0 else 0.0


def variation_of_information_extended(pairs: DataFrame, x: str, y: str, key: str = "symbol") -> DataFrame:
    """key, bins, vi: the same information with each key's own number of bins."""
    return information(pairs, x, y, None, key).select(key, "bins", "vi")


#: Rows of a block at least, and blocks of a key at most: longer keys have longer blocks.
LEAST_BLOCK, MOST_BLOCKS = 1 << 15, 1024


def _blocks(df: DataFrame, axis: str, least: int) -> DataFrame:
    """df (key, id, x, y, n and others) with rank along an axis, block, and the axis' sums before the block and in all.

    Blocks are runs of equal length in order of the axis, so their number is bounded for each key.
    """
    number = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(F.col("n") / least)))
    dealt = ranked(df, "key", [axis, "id"], f"ranked-{axis}").withColumn("block", F.floor(F.col("rank") * number / F.col("n")).cast("long"))
    w = Window.partitionBy("key")
    sums = dealt.groupBy("key", "block").agg(F.sum(axis).alias("_sum"))
    sums = sums.select("key", "block", F.coalesce(F.sum("_sum").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("_sum").over(w).alias("total"))
    return dealt.join(sums, ["key", "block"])


def _from_ranks(v: np.ndarray, rows) -> np.ndarray:
    """Mean distance of each value of a sorted block to all values of its key."""
    rank, n, total = rows["rank"].to_numpy(), rows["n"].to_numpy(), rows["total"].to_numpy()
    before = rows["before"].to_numpy() + np.cumsum(v) - v
    return (v * rank - before + (total - before - v) - v * (n - 1 - rank)) / n


def _concordant(x: np.ndarray, y: np.ndarray, other: np.ndarray) -> float:
    """Sum of (x - x')(y - y') over the pairs of a place and one before it whose value of other is smaller."""
    s = sums_below(other, np.stack([np.ones(len(x)), x, y, x * y]))
    return float((x * y * s[0] - x * s[2] - y * s[1] + s[3]).sum())


def _along_x(rows: pd.DataFrame) -> pd.DataFrame:
    """Mean distances along x, and on the first row what the block's own pairs add to the concordant ones."""
    rows = rows.sort_values("rank")
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    part = np.zeros(len(rows))
    part[0] = _concordant(x, y, y)
    return rows[["key", "id", "x", "y", "n", "block"]].rename(columns={"block": "x_block"}).assign(mx=_from_ranks(x, rows), part=part)


_SUMS = ("x", "y", "xx", "yy", "xy", "mx", "my", "mxx", "myy", "mxy", "part")


def _along_y(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of each block of x within the block of y, and on the first row those of the whole block, with what pairs
    in different blocks of x add to the concordant ones."""
    rows = rows.sort_values("rank")
    x, y, mx, at = (rows[c].to_numpy() for c in ("x", "y", "mx", "x_block"))
    my = _from_ranks(y, rows)
    whole = dict(zip(_SUMS, (float(v.sum()) for v in (x, y, x * x, y * y, x * y, mx, my, mx * mx, my * my, mx * my, rows["part"].to_numpy()))))
    whole["part"] += _concordant(x, y, at)
    blocks, place = np.unique(at, return_inverse=True)
    cells = {f"c_{c}": np.bincount(place, v) for c, v in (("1", np.ones(len(x))), ("x", x), ("y", y), ("xy", x * y))}
    out = pd.DataFrame({"key": rows["key"].iloc[0], "n": rows["n"].iloc[0], "x_block": blocks, "y_block": rows["block"].iloc[0], **cells})
    first = np.arange(len(blocks)) == 0
    return out.assign(**{c: np.where(first, v, 0.0) for c, v in whole.items()})


def _of_cells(rows: pd.DataFrame) -> float:
    """Distance correlation of a key from its cells: pairs whose blocks of x and of y both differ are added up here."""
    n, s = float(rows["n"].iloc[0]), {c: float(rows[c].sum()) for c in _SUMS}
    at = rows["x_block"].to_numpy(), rows["y_block"].to_numpy()
    grid = {}
    for c in ("1", "x", "y", "xy"):
        grid[c] = np.zeros((at[0].max() + 1, at[1].max() + 1))
        grid[c][at] = rows[f"c_{c}"]
    below = {c: np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))[:-1, :-1] for c, g in grid.items()}
    concordant = s["part"] + float((grid["xy"] * below["1"] - grid["x"] * below["y"] - grid["y"] * below["x"] + grid["1"] * below["xy"]).sum())
    # of all pairs the concordant ones count as they are, the others with the opposite sign
    together = 2 * (2 * concordant - (n * s["xy"] - s["x"] * s["y"]))
    covariance = together / n**2 - 2 * s["mxy"] / n + s["mx"] * s["my"] / n**2
    var = [2 * (s[a + a] / n - (s[a] / n) ** 2) - 2 * s[f"m{a}{a}"] / n + (s[f"m{a}"] / n) ** 2 for a in "xy"]
    scale = math.sqrt(max(var[0], 0.0) * max(var[1], 0.0))
    return math.sqrt(max(covariance, 0.0) / scale) if scale > 0 else 0.0


def distance_correlations(pairs: DataFrame, x: str, y: str, key: str = "symbol", least_block: int | None = None) -> DataFrame:
    """key and dcor; rows with a value that is null or no number are left out, a constant side gives 0.

    Rows are sorted along x and then along y and dealt into blocks each time.  The sum over pairs of both distances
    is merge counting within a block of x, within a block of y for rows of different blocks of x, and between the
    cells that both make for the rest.  So no task has more than a block, or the table of a key's cells.
    """
    ship(pairs.sparkSession)
    kind, least = dict(pairs.dtypes)[key], least_block or LEAST_BLOCK
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = pairs.filter(F.col(key).isNotNull() & known(x) & known(y)).select(F.col(key).alias("key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    means = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    points = materialise(rows.join(means, "key").select("key", F.monotonically_increasing_id().alias("id"), (F.col("_x") - F.col("_mx")).alias("x"), (F.col("_y") - F.col("_my")).alias("y"), "n"), "pairs")
    columns = f"key {kind}, id long, x double, y double, n long, x_block long, mx double, part double"
    met = materialise(_blocks(points, "x", least).groupBy("key", "block").applyInPandas(_along_x, columns), "along-x")
    columns = f"key {kind}, n long, x_block long, y_block long, " + ", ".join(f"{c} double" for c in ("c_1", "c_x", "c_y", "c_xy", *_SUMS))
    cells = _blocks(met, "y", least).groupBy("key", "block").applyInPandas(_along_y, columns)

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [name[0]], "dcor": [_of_cells(rows)]})

    return cells.groupBy("key").applyInPandas(run, f"{key} {kind}, dcor double")
