"""Structural breaks: sup-ADF sequences from prefix sums, bubble episodes, CUSUM tests, change points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grouped import fold_series, nan_to_none, per_series, scalars
from ..functions.series import ordered
from ..runtime import ship


def lagged(df: DataFrame, column: str, lags: int | list[int], key: str = "symbol", order: str = "ts") -> DataFrame:
    """df with column_lag<k>: for an integer k from 0 to it, for a list those."""
    w = ordered(key, order)
    return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(w) for k in (range(lags + 1) if isinstance(lags, int) else lags)})


def adf_design(series: DataFrame, constant: str, lags: int, value: str = "x") -> DataFrame:
    """symbol, pos, y and the regressors: level before, lagged differences, constant, trend, squared trend."""
    if constant not in ("nc", "c", "ct", "ctt"):
        raise ValueError("constant is nc, c, ct or ctt")
    w = ordered("symbol", "ts")
    d = series.withColumn("pos", F.row_number().over(w)).withColumn("_d", F.col(value) - F.lag(value).over(w))
    cols = {"level": F.lag(value).over(w)} | {f"delta{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}
    if constant != "nc":
        cols["constant"] = F.lit(1.0)
    if constant in ("ct", "ctt"):
        cols["trend"] = F.col("pos").cast("double")
    if constant == "ctt":
        cols["trend2"] = F.pow(F.col("pos"), 2)
    return d.withColumns(cols).filter(F.col("pos") > lags + 1).select("symbol", "ts", "pos", F.col("_d").alias("y"), *cols)


def design(x: np.ndarray, constant: str = "c", lags: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, regressors and 1-based positions of one series."""
    d, n = np.diff(x), len(x)
    pos = np.arange(lags + 2, n + 1)
    cols = [x[pos - 2]] + [d[pos - 2 - k] for k in range(1, lags + 1)]
    cols += [np.ones(len(pos))] * (constant != "nc") + [pos.astype(float)] * (constant in ("ct", "ctt")) + [pos.astype(float) ** 2] * (constant == "ctt")
    return d[pos - 2], np.column_stack(cols), pos


def minimum_window(n: int) -> int:
    return max(round((0.01 + 1.8 / math.sqrt(n)) * n), 3) if n else 3


def sup_adf(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(SADF, BSADF) by end point, nan where undefined: all starts of one end at once."""
    n = len(x)
    sadf, bsadf = np.full(n, np.nan), np.full(n, np.nan)
    level, d = x[:-1], np.diff(x)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (level, level**2, d, level * d, d * d)]
    for end in range(least, n):
        start = np.arange(end - least + 1)
        m = end - start
        sx, sxx, sd, sxd, sdd = (s[end] - s[start] for s in sums)
        den = m * sxx - sx * sx
        ok = (den > 0) & (m >= 3)
        with np.errstate(all="ignore"):
            beta = (m * sxd - sx * sd) / den
            rest = np.maximum(sdd - (sd - beta * sx) / m * sd - beta * sxd, 0)
            var = rest / (m - 2) * m / den
            t = beta / np.sqrt(var)
        ok &= var > 0
        if ok[0]:
            sadf[end] = t[0]
        if ok.any():
            bsadf[end] = t[ok].max()
    return sadf, bsadf


#: Positions of a tile's side; a tile has at most the square of it in pairs.
TILE = 256


def triangle(ends: DataFrame, end: str, starts: DataFrame, start: str, key: str = "symbol", tile: int | None = None) -> DataFrame:
    """Each row of ends with all rows of starts of its key whose block of positions is its own or an earlier one.

    Rows meet in tiles, a block of starts by a block of ends, which are the join's keys: tiles are of equal work
    whatever the length of a series, so a long one is spread over as many tasks as it has tiles.
    """
    tile = tile or TILE
    block = lambda c: F.floor(F.col(c) / tile).cast("int")
    blocks = ends.groupBy(key).agg(F.max(block(end)).alias("_last"))
    a = starts.join(blocks, key).withColumn("_start", block(start)).filter("_start <= _last")
    a = a.withColumn("_end", F.explode(F.sequence("_start", "_last"))).drop("_last")
    e = ends.withColumn("_end", block(end)).withColumn("_start", F.explode(F.sequence(F.lit(0), "_end")))
    return e.join(a, [key, "_start", "_end"]).drop("_start", "_end")


def psy_sequences(series: DataFrame, least: int, value: str = "x") -> DataFrame:
    """symbol, pos, sadf, bsadf as one SQL plan: a table of prefix sums joined with itself,
    tile by tile, on start <= end - least."""
    w = ordered("symbol", "ts")
    s = series.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("pos", F.row_number().over(w) - 1).withColumn("nxt", F.lead(value).over(w))
    run = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = F.coalesce(F.col("nxt") - F.col(value), F.lit(0.0))
    total = lambda e: F.coalesce(F.sum(e).over(run), F.lit(0.0))
    p = s.select("symbol", "ts", "pos", total(F.col(value)).alias("sx"), total(F.col(value) * F.col(value)).alias("sxx"), total(d).alias("sd"), total(F.col(value) * d).alias("sxd"), total(d * d).alias("sdd"))
    a = p.select("symbol", F.col("pos").alias("r1"), *[F.col(c).alias("a_" + c) for c in ("sx", "sxx", "sd", "sxd", "sdd")])
    j = triangle(p.withColumnRenamed("pos", "r2"), "r2", a, "r1").filter(F.col("r1") <= F.col("r2") - least)
    j = j.withColumn("n", (F.col("r2") - F.col("r1")).cast("double")).withColumns({c: F.col(c) - F.col("a_" + c) for c in ("sx", "sxx", "sd", "sxd", "sdd")})
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    j = j.withColumn("den", den).withColumn("beta", F.try_divide(F.col("n") * F.col("sxd") - F.col("sx") * F.col("sd"), F.col("den")))
    rest = F.greatest(F.col("sdd") - (F.col("sd") - F.col("beta") * F.col("sx")) / F.col("n") * F.col("sd") - F.col("beta") * F.col("sxd"), F.lit(0.0))
    j = j.withColumn("var", F.try_divide(F.try_divide(rest, F.col("n") - 2) * F.col("n"), F.col("den")))
    t = F.when((F.col("den") > 0) & (F.col("n") >= 3) & (F.col("var") > 0), F.try_divide(F.col("beta"), F.sqrt("var")))
    j = j.withColumn("t", t)
    return j.groupBy("symbol", "ts", "r2").agg(F.max(F.when(F.col("r1") == 0, F.col("t"))).alias("sadf"), F.max("t").alias("bsadf")).withColumn("pos", (F.col("r2") + 1).cast("long")).drop("r2")


def gsadf(series: DataFrame, least: int, value: str = "x") -> DataFrame:
    return psy_sequences(series, least, value).groupBy("symbol").agg(F.max("sadf").alias("sadf"), F.max("bsadf").alias("gsadf"))


class Recursive:
    """Least squares over rows that come one by one: coefficients, inverse of the moments and residual squares are
    updated by each row, so a series needs one pass and a state of the regressors' number squared.

    Until the moments can be inverted, they are added up; no statistic is defined before.
    """

    def __init__(self):
        self.n, self.inverse = 0, None

    def add(self, z: np.ndarray, y: float) -> float:
        """Take a row; its standardised prediction error from the rows before, nan where those didn't suffice."""
        if self.n == 0:
            self.moments, self.cross, self.squares = np.zeros((len(z), len(z))), np.zeros(len(z)), 0.0
        self.n += 1
        if self.inverse is None:
            self.moments += np.outer(z, z)
            self.cross += z * y
            self.squares += y * y
            if self.n >= len(z) and np.linalg.matrix_rank(self.moments, hermitian=True) == len(z):
                self.inverse = np.linalg.inv(self.moments)
                self.beta = self.inverse @ self.cross
                self.rest = max(self.squares - self.beta @ self.cross, 0.0)
            return math.nan
        gain = self.inverse @ z
        scale = 1 + z @ gain
        error = y - z @ self.beta
        self.beta = self.beta + gain * (error / scale)
        self.inverse = self.inverse - np.outer(gain, gain) / scale
        self.rest += error * error / scale
        return error / math.sqrt(scale)

    def t(self, k: int = 0) -> float:
        """t statistic of a coefficient; nan where the fit is singular or has no residual freedom."""
        if self.inverse is None or self.n <= len(self.beta):
            return math.nan
        var = self.rest / (self.n - len(self.beta)) * self.inverse[k, k]
        return float(self.beta[k] / math.sqrt(var)) if var > 0 else math.nan


def _recursive(series: DataFrame, constant: str, lags: int, value: str, backward: bool, give, name: str) -> DataFrame:
    """symbol, pos and give(fit, error) after each row of the design, from the first one or from the last."""
    rows = adf_design(series.filter(F.col("symbol").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)), constant, lags, value)
    columns = [c for c in rows.columns if c not in ("symbol", "ts", "pos", "y")]
    rows = rows.select("symbol", F.col("pos").cast("long").alias("pos"), "y", *columns, (-F.col("pos") if backward else F.col("pos")).cast("long").alias("_order"))

    def step(fit: Recursive, part: pd.DataFrame) -> list:
        out = []
        for pos, y, z in zip(part["pos"], part["y"].to_numpy(float), part[columns].to_numpy(float)):
            v = give(fit, fit.add(z, y))
            if v is not None:
                out.append((pos, v if math.isfinite(v) else None))
        return out

    return fold_series(rows, "symbol", ["_order"], Recursive, step, ["pos", name], f"pos long, {name} double")


def expanding_adf(series: DataFrame, least: int, constant: str = "c", lags: int = 0, value: str = "x") -> DataFrame:
    """symbol, pos, adf: t statistic of the level over all rows up to each, of `least` rows or more; one pass."""
    return _recursive(series, constant, lags, value, False, lambda fit, e: fit.t() if fit.n >= least else None, "adf")


def backward_adf(series: DataFrame, least: int, constant: str = "c", lags: int = 0, value: str = "x") -> DataFrame:
    """symbol, pos, adf: t statistic of the level from each row on to the last, of `least` rows or more; one pass."""
    return _recursive(series, constant, lags, value, True, lambda fit, e: fit.t() if fit.n >= least else None, "adf")


def backward_sup_adf(series: DataFrame, least: int, constant: str = "c", lags: int = 0, value: str = "x") -> DataFrame:
    """symbol, bsadf: the greatest of the backward statistics; null where none is defined."""
    return backward_adf(series, least, constant, lags, value).groupBy("symbol").agg(F.max("adf").alias("bsadf"))


def quantile_adf(series: DataFrame, least: int, constant: str = "c", lags: int = 1, q: float = 0.95, value: str = "x") -> DataFrame:
    """symbol, sadf, qadf, cadf: sup, quantile and mean of the tail of the backward statistics; null where none is."""
    t = backward_adf(series, least, constant, lags, value).withColumnRenamed("adf", "t")
    cut = t.groupBy("symbol").agg(F.max("t").alias("sadf"), F.percentile("t", q).alias("qadf"))
    tail = t.join(cut, "symbol").groupBy("symbol", "sadf", "qadf").agg(F.avg(F.when(F.col("t") >= F.col("qadf"), F.col("t"))).alias("cadf"))
    return tail.select("symbol", "sadf", "qadf", "cadf")


def bubble_episodes(stats: DataFrame, value: str, critical, least: int = 1) -> DataFrame:
    """symbol, start, collapse, length: runs above the critical value (number or column) of `least` rows or more.

    collapse is the first position back below, or the last one.
    """
    w = ordered("symbol", "pos")
    above = F.coalesce((F.col(value) > (F.col(critical) if isinstance(critical, str) else F.lit(float(critical)))) & ~F.isnan(value), F.lit(False))
    s = stats.withColumn("_a", above).withColumn("_next", F.coalesce(F.lead("pos").over(w), F.col("pos")))
    s = s.withColumn("_run", F.sum((F.col("_a") != F.coalesce(F.lag("_a").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.filter("_a").groupBy("symbol", "_run").agg(F.min("pos").alias("start"), F.max("_next").alias("collapse"), F.count(F.lit(1)).alias("length"))
    return runs.filter(F.col("length") >= least).select("symbol", "start", "collapse", "length")


def simulate_critical_values(spark: SparkSession, n: int, least: int | None = None, simulations: int = 2000, level: float = 0.95, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(per end point, global) critical values under a random walk: simulations are rows, folded in Python by batch."""
    ship(spark)
    least = least or minimum_window(n)

    def run(batches):
        for batch in batches:
            rows = []
            for s in batch["id"]:
                walk = np.cumsum(np.random.default_rng([seed, int(s)]).standard_normal(n))
                a, b = sup_adf(walk, least)
                rows += [(int(s), k + 1, float(a[k]) if np.isfinite(a[k]) else None, float(b[k]) if np.isfinite(b[k]) else None) for k in range(least, n)]
            yield pd.DataFrame(rows, columns=["id", "pos", "sadf", "bsadf"])

    paths = spark.range(simulations).repartition(min(simulations, 64)).mapInPandas(run, "id long, pos long, sadf double, bsadf double")
    by_end = paths.groupBy("pos").agg(F.percentile("sadf", level).alias("sadf_cv"), F.percentile("bsadf", level).alias("bsadf_cv"))
    sups = paths.groupBy("id").agg(F.max("sadf").alias("s"), F.max("bsadf").alias("g"))
    return by_end, sups.agg(F.percentile("s", level).alias("sadf_cv"), F.percentile("g", level).alias("gsadf_cv"))


def _sups(x: np.ndarray, least: int) -> tuple[float, float]:
    return tuple(float(np.nanmax(s)) if np.isfinite(s).any() else math.nan for s in sup_adf(x, least))


def _wild_path(x: np.ndarray, seed: int, path: int) -> np.ndarray:
    """The series itself as path 0; else one whose steps keep their size and get random signs."""
    if not path:
        return x
    steps = np.diff(x) - np.diff(x).mean()
    return np.concatenate([[x[0]], x[0] + np.cumsum(steps * np.random.default_rng([seed, path]).choice([-1.0, 1.0], len(steps)))])


def _verdict(seen: tuple, drawn: list[tuple]) -> dict:
    p = [(1 + sum(d[k] >= seen[k] for d in drawn)) / (len(drawn) + 1) for k in (0, 1)]
    return {"sadf": seen[0], "gsadf": seen[1], "sadf_pvalue": p[0], "gsadf_pvalue": p[1], "reject_sadf": p[0] < 0.05, "reject_gsadf": p[1] < 0.05}


def wild_bootstrap_sadf(x: np.ndarray, least: int | None = None, paths: int = 99, seed: int = 0) -> dict:
    """SADF and GSADF with p-values from wild bootstrap paths."""
    if len(x) < 8:
        raise ValueError("at least 8 values are needed")
    least = least or minimum_window(len(x))
    return _verdict(_sups(x, least), [_sups(_wild_path(x, seed, k), least) for k in range(1, paths + 1)])


def volatility_robust_sadf(series: DataFrame, least: int | None = None, paths: int = 99, seed: int = 0, value: str = "x") -> DataFrame:
    """symbol and the same: a row of (symbol, path) is a unit of work, so paths are spread over tasks, and p-values
    are counted from their statistics.  A symbol of fewer than 8 known values has null statistics."""
    ship(series.sparkSession)
    known = series.filter(F.col("symbol").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    x = known.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", F.col(value).alias("x")))).alias("v")).select("symbol", F.col("v.x").alias("x"))
    work = x.filter(F.size("x") >= 8).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths)))).repartition("symbol", "path")

    def run(batches):
        for b in batches:
            found = []
            for v, k in zip(b["x"], b["path"]):
                v = np.asarray(v, float)
                found.append(_sups(_wild_path(v, seed, int(k)), least or minimum_window(len(v))))
            yield pd.DataFrame({"symbol": b["symbol"], "path": b["path"], "s": nan_to_none([f[0] for f in found]), "g": nan_to_none([f[1] for f in found])})

    stats = work.mapInPandas(run, "symbol string, path int, s double, g double")
    seen = stats.filter("path = 0").select("symbol", F.col("s").alias("sadf"), F.col("g").alias("gsadf"))
    p = lambda c, own: ((1 + F.sum(F.when((F.col("path") > 0) & (F.col(c) >= F.col(own)), 1).otherwise(0))) / F.lit(paths + 1.0)).alias(own + "_pvalue")
    counted = stats.join(seen, "symbol").groupBy("symbol", "sadf", "gsadf").agg(p("s", "sadf"), p("g", "gsadf"))
    out = x.select("symbol").join(counted, "symbol", "left")
    return out.select("symbol", "sadf", "gsadf", "sadf_pvalue", "gsadf_pvalue", (F.col("sadf_pvalue") < 0.05).alias("reject_sadf"), (F.col("gsadf_pvalue") < 0.05).alias("reject_gsadf"))


def chu_stinchcombe_white(series: DataFrame, value: str = "x") -> DataFrame:
    """symbol, pos, csw, start: the greatest standardised departure of a log price from an earlier one."""
    w = ordered("symbol", "ts")
    s = series.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("_d2", F.pow(F.col(value) - F.lag(value).over(w), 2))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_var", F.sum("_d2").over(run) / F.nullif(F.col("pos") - 1, F.lit(0)))
    a = s.select("symbol", F.col("pos").alias("start"), F.col(value).alias("x0"))
    j = triangle(s.select("symbol", "pos", value, "_var"), "pos", a, "start").filter((F.col("start") < F.col("pos")) & (F.col("_var") > 0))
    stat = F.abs(F.col(value) - F.col("x0")) / F.sqrt(F.col("_var") * (F.col("pos") - F.col("start")))
    return j.groupBy("symbol", "pos").agg(F.max(stat).alias("csw"), F.max_by("start", F.struct(F.round(stat, 12), -F.col("start"))).alias("start"))


def brown_durbin_evans(series: DataFrame, constant: str = "c", lags: int = 1, value: str = "x") -> DataFrame:
    """symbol, pos, cusum: one-step prediction errors in units of their standard deviation, added up.

    Errors begin once the fit has a row more than regressors; one pass gives them, then sums per symbol.
    """
    m = 1 + lags + (constant != "nc") + (constant in ("ct", "ctt")) + (constant == "ctt")
    errors = _recursive(series, constant, lags, value, False, lambda fit, e: e if fit.n > m + 1 else None, "error").filter(F.col("error").isNotNull())
    scale = errors.groupBy("symbol").agg(F.nullif(F.stddev_samp("error"), F.lit(0.0)).alias("_scale"))
    w = ordered("symbol", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return errors.join(scale, "symbol").select("symbol", "pos", (F.sum("error").over(w) / F.col("_scale")).alias("cusum"))


def chow_dickey_fuller(series: DataFrame, least: int, value: str = "x") -> DataFrame:
    """symbol, pos (from 0), dfc: t value of the level after a break there, for breaks at least so many steps from both ends.

    The differences are regressed on the level from the break on and on nought before it, so sums from each row to the
    end give all breaks in one sorted pass.  Where a symbol has a missing value all its statistics are null, as is one
    without residuals or whose level is nought after the break; symbols too short for any break have no row.
    """
    w = ordered("symbol", F.desc("ts"))
    x = F.when(~F.isnan(value), F.col(value))
    steps = series.select("symbol", "ts", x.alias("_x")).select("symbol", "ts", "_x", (F.lag("_x").over(w) - F.col("_x")).alias("_d"), F.row_number().over(w).alias("_back"))
    level = F.when(F.col("_back") > 1, F.col("_x"))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("symbol", "_back", F.sum(level * level).over(past).alias("_xx"), F.sum(level * F.col("_d")).over(past).alias("_xd"))
    # as many rows as the series has, of which all but the last have a step
    totals = steps.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.count("_d").alias("_known"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    j = sums.join(totals, "symbol").withColumn("pos", (F.col("_n") - F.col("_back")).cast("long")).filter((F.col("pos") >= least) & (F.col("pos") < F.col("_n") - 1 - least))
    beta = F.try_divide(F.col("_xd"), F.col("_xx"))
    variance = F.try_divide((F.col("_dd") - beta * F.col("_xd")) / (F.col("_n") - 2), F.col("_xx"))
    return j.select("symbol", "pos", F.when((F.col("_known") == F.col("_n") - 1) & (variance > 0), beta / F.sqrt(variance)).alias("dfc"))


def change_points(x: np.ndarray, model: str = "normal", penalty: float = 3.0, least: int = 10, jump: int = 5) -> list[int]:
    """0-based inner boundaries that minimise cost plus penalty * log(n) per segment (PELT).

    Candidates stand at multiples of jump.  Pruning pairs the kept starts with the costs in order,
    also where a start without a cost was skipped; published results depend on it.
    """
    if model not in ("normal", "l2"):
        raise ValueError("model is normal or l2")
    n = len(x)
    if n < 2 * least:
        return []
    least = max(least, 2 if model == "normal" else 1)
    s1, s2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        m = b - a
        mean = (s1[b] - s1[a]) / m
        var = np.maximum((s2[b] - s2[a]) / m - mean * mean, 0)
        return m * (np.log(var + 1e-6) if model == "normal" else var)

    beta = penalty * math.log(n)
    best, before, starts = {0: 0.0}, {}, []
    for end in [k for k in range(0, n, jump) if k >= least] + [n]:
        starts.append((end - least) // jump * jump)
        usable = np.array([s for s in starts if s in best])
        total = np.array([best[s] for s in usable]) + cost(usable, end) + beta
        k = int(total.argmin())
        best[end], before[end] = float(total[k]), int(usable[k])
        starts = [s for s, c in zip(starts, total) if c <= best[end] + beta]
    found, at = [], n
    while at:
        at = before[at]
        found.append(at)
    return sorted(b for b in found if 0 < b < n)


def pelt(series: DataFrame, value: str = "x", **parameters) -> DataFrame:
    """symbol, change_point."""

    def run(rows):
        return pd.DataFrame({"change_point": change_points(rows[value].to_numpy(float), **parameters)}, dtype="int64")

    return per_series(series.select("symbol", "ts", value), "symbol", ["ts"], run, "change_point long")
