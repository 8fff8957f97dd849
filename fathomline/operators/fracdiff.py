"""Fractional differences: lag sums for short weights, convolution per series for long ones."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grouped import nan_to_none, per_series, scalars
from ..functions.normal import horner, phi
from ..functions.series import ordered
from ..functions.special import DF_LARGE, DF_MAX, DF_MIN, DF_SMALL, DF_STAR, adf_pvalue, adf_statistic
from ..runtime import materialise, ship, small_batches

ANCHOR_THRESHOLDS = (1e-3, 1e-4, 1e-5)
ORDERS = tuple(round(0.05 * k, 2) for k in range(25))
#: Weights up to this many are lag expressions of one window; more are a convolution by blocks.
MOST_LAGS = 64
#: Values of a block, whose part in each later block is one task's product of transforms.
BLOCK = 1 << 13


def binomial_weights(d: float, n: int) -> np.ndarray:
    """The first n weights of (1 - lag) ** d, the newest value's first."""
    k = np.arange(1, n)
    return np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])


def fixed_weights(d: float, threshold: float = 1e-5, most: int = 100_000) -> np.ndarray:
    """Weights up to the first one below the threshold, the newest value's first."""
    w = binomial_weights(d, most)
    small = np.flatnonzero(np.abs(w) < threshold)
    return w[: small[0]] if len(small) else w


def fixed_difference(x: np.ndarray, d: float, threshold: float = 1e-5) -> np.ndarray:
    """nan until the window is full."""
    w = fixed_weights(d, threshold, max(2, len(x) + 2))
    out = np.full(len(x), np.nan)
    if len(w) <= len(x):
        out[len(w) - 1 :] = np.convolve(x, w, "valid")
    return out


def expanding_difference(x: np.ndarray, d: float, threshold: float = 0.01) -> np.ndarray:
    """All past values; rows are nan while the weights left out are over the threshold."""
    n = len(x)
    w = binomial_weights(d, n)
    out = np.convolve(x, w)[:n].astype(float)
    loss = np.cumsum(np.abs(w[::-1]))
    out[: int((loss / loss[-1] < threshold).sum())] = np.nan
    return out


def ffd(series: DataFrame, d: float, threshold: float = 1e-5, value: str = "x") -> DataFrame:
    """series with ffd, null until the window is full."""
    w = fixed_weights(d, threshold)
    if len(w) > MOST_LAGS:
        return _over_past(series, d, value, "ffd", lambda n: fixed_weights(d, threshold, max(2, n + 2)), None)
    o = ordered("symbol", "ts")
    return series.withColumn("ffd", _lag_sum(w, value, o))


def _lag_sum(weights, value: str, o) -> Column:
    """Weights, the newest value's first, times a value and those before it; null where any is missing."""
    return sum((F.lag(value, k).over(o) * float(v) for k, v in enumerate(weights) if k), F.col(value) * float(weights[0]))


def apply(series: DataFrame, fn, name: str, value: str = "x") -> DataFrame:
    """symbol, ts, value and fn of the whole series as a new column."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ts": rows["ts"], value: rows[value], name: nan_to_none(fn(rows[value].to_numpy(float)))})

    return per_series(series.select("symbol", "ts", value), "symbol", ["ts"], run, f"ts timestamp_ntz, {value} double, {name} double")


def frac_diff_expanding(series: DataFrame, d: float, threshold: float = 0.01, value: str = "x") -> DataFrame:
    """series with fracdiff over all past values, null while the weights left out are over the threshold."""
    return _over_past(series, d, value, "fracdiff", lambda n: binomial_weights(d, n), threshold)


def _over_past(series: DataFrame, d: float, value: str, name: str, weights, loss: float | None) -> DataFrame:
    """symbol, ts, value and the sum of each row's past values times weights(n), n being its series' length.

    Overlap-add by blocks: what a block of values adds to a block of rows is one product of Fourier transforms; each
    (block of values, block of rows) is independent, and their sums are added up by row block as a stream.  So a
    series is spread over tasks and no task holds more than its weights and some blocks.  Rows without a symbol are
    left out.  loss: null while the share of weights left out is below it (all past); None: null until the window of
    the weights is full.  A null or nan value makes the rows null whose sum would hold it.
    """
    ship(series.sparkSession)
    block = BLOCK
    o = ordered("symbol", "ts")
    known = F.col(value).isNotNull() & ~F.isnan(value)
    s = series.filter(F.col("symbol").isNotNull()).select("symbol", "ts", value).withColumn("_pos", (F.row_number().over(o) - 1).cast("long"))
    s = materialise(s.withColumn("_gaps", F.sum((~known).cast("long")).over(o.rowsBetween(Window.unboundedPreceding, 0))), "past")
    sizes = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))

    def skipped(batches):
        for b in batches:
            out, lengths = [], []
            for n in b["_n"]:
                w = weights(int(n))
                lengths.append(len(w))
                if loss is None:
                    out.append(len(w) - 1)
                else:
                    left = np.cumsum(np.abs(w[::-1]))
                    out.append(int((left / left[-1] < loss).sum()))
            yield b.assign(_skip=out, _width=lengths)

    sizes = sizes.mapInPandas(skipped, "symbol string, _n long, _skip long, _width long")
    at = F.floor(F.col("_pos") / block).cast("long")
    values = s.join(sizes.select("symbol", "_n"), "symbol").groupBy("symbol", "_n", at.alias("_from")).agg(F.array_sort(F.collect_list(F.struct("_pos", F.when(known, F.col(value)).otherwise(0.0).alias("x")))).alias("v"))
    values = values.select("symbol", "_n", "_from", F.col("v.x").alias("v"))

    def parts(batches):
        kept: dict = {}
        for b in batches:
            for symbol, n, start, v in zip(b["symbol"], b["_n"], b["_from"], b["v"]):
                if kept.get("n") != n:
                    kept = {"n": n, "w": weights(int(n))}
                w, transform = kept["w"], np.fft.rfft(np.asarray(v, float), 2 * block)
                for to in range(start, min((n - 1) // block, start + (len(w) + block - 2) // block) + 1):
                    low = (to - start) * block - block + 1
                    if low not in kept:
                        segment = np.zeros(2 * block)
                        lags = w[max(low, 0) : low + 2 * block - 1]
                        segment[max(-low, 0) : max(-low, 0) + len(lags)] = lags
                        kept[low] = np.fft.rfft(segment)
                    yield pd.DataFrame({"symbol": [symbol], "_to": [to], "v": [np.fft.irfft(transform * kept[low], 2 * block)[block - 1 : 2 * block - 1]]})
                    if len(kept) > 64:
                        kept = {"n": n, "w": w}

    def added(batches):
        key, total = None, None
        for b in batches:
            for symbol, to, v in zip(b["symbol"], b["_to"], b["v"]):
                if (symbol, to) == key:
                    total = total + np.asarray(v)
                    continue
                if key:
                    yield pd.DataFrame({"symbol": [key[0]], "_to": [key[1]], "v": [total]})
                key, total = (symbol, to), np.asarray(v)
        if key:
            yield pd.DataFrame({"symbol": [key[0]], "_to": [key[1]], "v": [total]})

    with small_batches(series.sparkSession, 64):
        sums = values.mapInPandas(parts, "symbol string, _to long, v array<double>").repartition("symbol", "_to").sortWithinPartitions("symbol", "_to")
        sums = materialise(sums.mapInPandas(added, "symbol string, _to long, v array<double>"), "past-sums")
    found = sums.select("symbol", "_to", F.posexplode("v").alias("_k", "_sum")).select("symbol", (F.col("_to") * block + F.col("_k")).alias("_pos"), "_sum")
    out = s.join(found, ["symbol", "_pos"]).join(sizes, "symbol")
    # how many of the values that a row's sum holds are missing
    earlier = s.select("symbol", (F.col("_pos") + 1).alias("_before"), F.col("_gaps").alias("_left"))
    out = out.withColumn("_before", F.col("_pos") - F.col("_width") + 1).join(earlier, ["symbol", "_before"], "left")
    whole = (F.col("_pos") >= F.col("_skip")) & (F.col("_gaps") - F.coalesce("_left", F.lit(0)) == 0)
    return out.select("symbol", "ts", value, F.when(whole, F.col("_sum")).alias(name))


def stationarity(x: np.ndarray, lags: int = 1) -> float:
    """ADF p-value; 1 for fewer than 20 values or a constant."""
    v = x[np.isfinite(x)]
    return 1.0 if len(v) < 20 or v.std() < 1e-8 else adf_pvalue(adf_statistic(v, lags))


def memory_kept(diffed: np.ndarray, level: np.ndarray) -> float:
    both = np.isfinite(diffed) & np.isfinite(level)
    a, b = diffed[both], level[both]
    return abs(np.corrcoef(a, b)[0, 1]) if len(a) >= 5 and a.std() > 0 and b.std() > 0 else np.nan


def fixed_differences(series: DataFrame, orders, threshold: float, value: str) -> DataFrame:
    """symbol, ts, value, d, x: the fixed-window difference of each order; short windows come from one sorted pass."""
    weights = {float(d): fixed_weights(d, threshold) for d in orders}
    o = ordered("symbol", "ts")
    short = [d for d, w in weights.items() if len(w) <= MOST_LAGS]
    kinds = F.array(*[F.struct(F.lit(d).alias("d"), _lag_sum(weights[d], value, o).alias("x")) for d in short])
    parts = [series.withColumn("_k", kinds).withColumn("_k", F.explode("_k")).select("symbol", "ts", value, "_k.d", "_k.x")] if short else []
    parts += [ffd(series, d, threshold, value).select("symbol", "ts", value, F.lit(d).alias("d"), F.col("ffd").alias("x")) for d in weights if d not in short]
    return functools.reduce(DataFrame.unionByName, parts)


def optimal_ffd(prices: DataFrame, threshold: float = 0.01) -> DataFrame:
    """symbol, d (0 to 1 in tenths), adf, p_value, correlation: of the log price's difference of that order its ADF
    statistic with a constant and one lag, and its absolute correlation with the log price.

    The regression needs only second moments of the difference, its level and its lagged step, so all is one
    aggregation.  Values that are missing, or whose window holds a price that isn't positive, are left out; statistics
    of fewer than six values (five for the correlation) or without variation are null.
    """
    level = prices.filter("symbol IS NOT NULL").select("symbol", "ts", F.when((F.col("close") > 0) & ~F.isnan("close"), F.ln("close")).alias("level"))
    x = fixed_differences(level, np.linspace(0, 1, 11), threshold, "level").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    o = Window.partitionBy("symbol", "d", F.col("x").isNull()).orderBy("ts")
    steps = x.withColumns({"_y": F.col("x") - F.lag("x").over(o), "_l": F.lag("x").over(o), "_z": F.lag("x").over(o) - F.lag("x", 2).over(o)})
    both = F.col("_z").isNotNull()
    moments = {a + b: F.covar_pop(F.when(both, F.col("_" + a)), F.when(both, F.col("_" + b))).alias(a + b) for a, b in ("ll", "zz", "yy", "lz", "ly", "zy")}
    g = steps.groupBy("symbol", "d").agg(F.count("_z").alias("n"), F.count("x").alias("values"), F.try_divide(F.covar_pop("x", "level"), F.stddev_pop("x") * F.stddev_pop(F.when(F.col("x").isNotNull(), F.col("level")))).alias("r"), *moments.values())
    det = F.col("ll") * F.col("zz") - F.col("lz") * F.col("lz")
    slope = F.try_divide(F.col("ly") * F.col("zz") - F.col("zy") * F.col("lz"), det)
    other = F.try_divide(F.col("zy") * F.col("ll") - F.col("ly") * F.col("lz"), det)
    variance = F.try_divide((F.col("yy") - slope * F.col("ly") - other * F.col("zy")) * F.col("zz"), det * (F.col("n") - 3))
    t = g.withColumn("adf", F.when((F.col("n") >= 4) & (variance > 0), slope / F.sqrt(variance)))
    small, large = (horner(tuple(f"{c!r}D" for c in reversed(p)), "adf") for p in (DF_SMALL, DF_LARGE))
    t = t.withColumn("_tail", F.expr(f"CASE WHEN adf <= {DF_STAR!r}D THEN {small} ELSE {large} END"))
    p = F.when(F.col("adf") > DF_MAX, 1.0).when(F.col("adf") < DF_MIN, 0.0).when(F.col("adf").isNotNull(), phi("_tail"))
    r = F.when(F.col("values") >= 5, F.abs("r"))
    return t.select("symbol", "d", "adf", p.alias("p_value"), r.alias("correlation"))


def least_stationary_difference(close: np.ndarray, threshold: float = 1e-5, step: float = 0.01, p: float = 0.05) -> np.ndarray:
    """Log prices differenced by the smallest multiple of step that passes the ADF test."""
    level = np.log(close)
    for k in range(1, int(2 / step) + 1):
        x = fixed_difference(level, k * step, threshold)
        v = x[np.isfinite(x)]
        if len(v) >= 8 and adf_pvalue(adf_statistic(v)) <= p:
            return x
    raise ValueError("no order up to 2 makes the series stationary")


def rescaled_range_hurst(x: np.ndarray) -> float:
    """Slope of log R/S on log window size over eight sizes spread evenly in the logarithm."""
    n = len(x)
    if n < 32:
        return np.nan
    sizes = sorted({int(s) for s in np.floor(10 ** np.linspace(np.log10(8), np.log10(n // 2), 8))})
    points = []
    for s in sizes:
        blocks = x[: n // s * s].reshape(-1, s)
        centred = blocks - blocks.mean(1, keepdims=True)
        spread, scale = np.ptp(np.cumsum(centred, 1), axis=1), blocks.std(1)
        if (scale > 0).any():
            points.append((np.log(s), np.log((spread[scale > 0] / scale[scale > 0]).mean())))
    return float(np.polyfit(*zip(*points), 1)[0]) if len(points) > 1 else np.nan


def differencing_order(increments: np.ndarray) -> float:
    h = rescaled_range_hurst(increments)
    return float(np.clip(h - 0.5, 0, 0.99)) if np.isfinite(h) else np.nan


def adaptive_difference(x: np.ndarray, significance: float = 0.05, lags: int = 1, orders=ORDERS, thresholds=ANCHOR_THRESHOLDS) -> dict:
    """Order anchored at half plus the memory of increments, raised only until the series is stationary."""
    level = x[np.isfinite(x)]
    memory = differencing_order(np.diff(level))
    if not np.isfinite(memory):
        return {"order": np.nan, "d_hat": np.nan, "adf_pvalue": 1.0, "memory_retained": np.nan, "threshold": np.nan, "series": np.empty(0)}
    anchor = float(np.clip(0.5 + memory, 0, max(orders)))

    def trial(order: float, threshold: float) -> tuple[np.ndarray, float]:
        y = fixed_difference(level, order, threshold)
        return y, stationarity(y, lags)

    def merit(threshold: float) -> tuple[bool, float]:
        y, p = trial(anchor, threshold)
        kept = memory_kept(y, level)
        return p < significance, kept if np.isfinite(kept) else -1.0

    usable = [t for t in thresholds if np.isfinite(fixed_difference(level, anchor, t)).sum() >= 20]
    threshold = max(usable, key=merit) if usable else thresholds[1]
    for order in (anchor, *(o for o in orders if o > anchor)):
        y, p = trial(order, threshold)
        if p < significance:
            break
    return {"order": order, "d_hat": memory, "adf_pvalue": p, "memory_retained": memory_kept(y, level), "threshold": threshold, "series": y}


def adaptive_orders(prices: DataFrame, value: str = "close") -> DataFrame:
    def run(rows):
        r = adaptive_difference(rows[value].to_numpy(float))
        return scalars(**{k: (float(v) if np.isfinite(v) else None) for k, v in r.items() if k != "series"})

    return per_series(prices.select("symbol", "ts", value), "symbol", ["ts"], run, "order double, d_hat double, adf_pvalue double, memory_retained double, threshold double")
