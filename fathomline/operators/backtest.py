"""Backtest statistics, Sharpe-ratio inference, strategy risk, bet sizing and multiple testing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grouped import per_series, scalars
from ..functions.normal import phi, phi_inv, phi_sql
from ..functions.series import ordered
from ..functions.special import EULER, norm_cdf, norm_ppf
from .joins import delta_sweep

# ---- returns and positions -------------------------------------------------------------------------


def sharpe(r: str, risk_free: float = 0.0) -> Column:
    """Aggregate: mean excess over population deviation; 0 where that is 0."""
    sd = F.stddev_pop(r)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.avg(r) - risk_free, sd))


def bet_timing(positions: DataFrame, value: str = "position") -> DataFrame:
    """symbol, ts where a position closes or flips, and each symbol's last ts."""
    w = ordered("symbol", "ts")
    last = F.lag(value).over(w)
    p = positions.withColumn("_last", last).withColumn("_end", F.lead("ts").over(w).isNull())
    closes = (F.col(value) == 0) & (F.col("_last") != 0)
    flips = (F.col(value) * F.col("_last")) < 0
    return p.filter(F.coalesce(closes, F.lit(False)) | F.coalesce(flips, F.lit(False)) | F.col("_end")).select("symbol", "ts")


def holding_rows(days: np.ndarray, position: np.ndarray) -> list[tuple[int, float, float]]:
    """(row, days held, weight) of each reduction; the entry time is averaged over additions."""
    entry, out = 0.0, []
    for k in range(1, len(position)):
        before, now = position[k - 1], position[k]
        change = now - before
        if change * before >= 0:
            if now:
                entry = (entry * before + days[k] * change) / now
            continue
        flips = now * before < 0
        out.append((k, days[k] - entry, abs(before if flips else change)))
        if flips:
            entry = days[k]
    return out


def holding_periods(positions: DataFrame, value: str = "position") -> DataFrame:
    def run(rows):
        t = pd.to_datetime(rows["ts"])
        days = ((t - t.iloc[0]).dt.total_seconds() / 86400).to_numpy()
        found = holding_rows(days, rows[value].to_numpy(float))
        return pd.DataFrame({"ts": [rows["ts"].iloc[k] for k, *_ in found], "days": [d for _, d, _ in found], "weight": [w for *_, w in found]})

    return per_series(positions.select("symbol", "ts", value), "symbol", ["ts"], run, "ts timestamp_ntz, days double, weight double")


def mean_holding_period(positions: DataFrame, value: str = "position") -> DataFrame:
    h = holding_periods(positions, value)
    return positions.select("symbol").distinct().join(h.groupBy("symbol").agg(F.try_divide(F.sum(F.col("days") * F.col("weight")), F.sum("weight")).alias("mean_days")), "symbol", "left")


def hhi(r: Column) -> Column:
    """Aggregate: Herfindahl index of shares, 0 for even ones; null for two or fewer, or a sum of 0."""
    n, s = F.count(r), F.sum(r)
    return F.when((n > 2) & (s != 0), F.try_divide(F.try_divide(F.sum(r * r), s * s) - F.try_divide(F.lit(1.0), n), 1 - F.try_divide(F.lit(1.0), n)))


def hhi_concentration(returns: DataFrame, value: str = "x") -> DataFrame:
    """symbol, positive, negative, time: concentration of gains, of losses, and of bets over months."""
    x = F.col(value)
    sides = returns.groupBy("symbol").agg(hhi(F.when(x >= 0, x)).alias("positive"), hhi(F.when(x < 0, x)).alias("negative"))
    months = returns.groupBy("symbol", F.date_trunc("month", "ts").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return sides.join(months.groupBy("symbol").agg(hhi(F.col("n")).alias("time")), "symbol")


def drawdowns(pnl: DataFrame, value: str = "pnl", dollars: bool = False) -> DataFrame:
    """symbol, start, high, drawdown, time_under_water (years): spells below one high-water mark.

    A spell ends with the last row under that mark.
    """
    w = ordered("symbol", "ts").rowsBetween(Window.unboundedPreceding, 0)
    g = pnl.withColumn("high", F.max(value).over(w)).groupBy("symbol", "high").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.min(value).alias("low"), F.count(F.lit(1)).alias("n"))
    g = g.filter((F.col("n") > 1) & (F.col("low") != F.col("high")))
    drop = F.col("high") - F.col("low") if dollars else 1 - F.try_divide(F.col("low"), F.col("high"))
    seconds = F.unix_micros(F.col("stop").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return g.select("symbol", "start", "high", drop.alias("drawdown"), (seconds / 1e6 / 86400 / 365.25).alias("time_under_water"))


def expected_drawdown(returns: np.ndarray, horizon: int, alpha: float = 0.9) -> float:
    """Mean of the worst 1 - alpha of the greatest drawdowns of all windows, the last one in part."""
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    wealth = np.cumprod(1 + returns)
    if not len(wealth):
        return 0.0
    windows = np.lib.stride_tricks.sliding_window_view(wealth, horizon) if 2 <= horizon <= len(wealth) else wealth[None]
    deepest = np.sort((1 - windows / np.maximum.accumulate(windows, 1)).max(1))[::-1]
    k = (1 - alpha) * len(deepest)
    whole = int(k)
    total = deepest[:whole].sum() + ((k - whole) * deepest[whole] if whole < len(deepest) else 0)
    return float(total / k)


def conditional_expected_drawdown(returns: DataFrame, horizon: int, alpha: float = 0.9, value: str = "x") -> DataFrame:
    """symbol, ced: mean of the worst 1 - alpha of the greatest drawdowns of all windows of `horizon` rows, the last one
    in part; a series shorter than that, or a horizon below 2, is one window.

    Each row of wealth goes to the windows that hold it, `horizon` copies, and windows are what is aggregated; wealth
    is a sum of logarithms, so a return of -1 or less makes it 0 from there on, which is a drawdown of 1.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    o = ordered("symbol", "ts")
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    s = returns.filter(F.col("symbol").isNotNull() & F.col(value).isNotNull()).select("symbol", F.row_number().over(o).alias("_pos"), F.sum(F.when(F.col(value) > -1, F.log1p(value)).otherwise(0.0)).over(run).alias("_log"), F.max((F.col(value) <= -1).cast("int")).over(run).alias("_lost"))
    sizes = s.groupBy("symbol").agg(F.max("_pos").alias("_n"))
    s = s.join(sizes, "symbol").withColumn("_h", F.when((F.lit(horizon) >= 2) & (F.lit(horizon) <= F.col("_n")), F.lit(horizon)).otherwise(F.col("_n")))
    first = F.greatest(F.col("_pos") - F.col("_h") + 1, F.lit(1))
    s = s.withColumn("_window", F.explode(F.sequence(first, F.least("_pos", F.col("_n") - F.col("_h") + 1))))
    w = Window.partitionBy("symbol", "_window").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.when(F.col("_lost") == 0, F.col("_log"))).over(w)
    drop = F.when(F.col("_lost") == 1, F.when(top.isNotNull(), 1.0).otherwise(0.0)).otherwise(1 - F.exp(F.col("_log") - top))
    deepest = s.withColumn("_drop", drop).groupBy("symbol", "_window").agg(F.max("_drop").alias("_drop"))
    # equal drawdowns are one row with their number, so ranks come from few rows
    same = deepest.groupBy("symbol", "_drop").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("symbol").orderBy(F.desc("_drop")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = (1 - alpha) * (F.sum("_c").over(Window.partitionBy("symbol")))
    taken = F.greatest(F.least(k - before, F.col("_c").cast("double")), F.lit(0.0))
    return same.withColumn("_k", k).withColumn("_taken", taken).groupBy("symbol").agg((F.sum(F.col("_taken") * F.col("_drop")) / F.max("_k")).alias("ced"))


# ---- Sharpe-ratio inference -----------------------------------------------------------------------


def long_run_variance(x: np.ndarray, lag: int, floor: float = 1e-12) -> float:
    """Bartlett-weighted sum of autocovariances."""
    x = x - x.mean()
    n = len(x)
    total = x @ x / n + sum(2 * (1 - k / (lag + 1)) * (x[k:] @ x[:-k]) / n for k in range(1, min(lag, n - 1) + 1))
    return max(float(total), floor)


def automatic_lag(n: int) -> int:
    return max(int(4 * (n / 100) ** (2 / 9)), 1)


def sharpe_influence(r: np.ndarray) -> np.ndarray:
    sd = r.std(ddof=1)
    if sd == 0:
        return np.zeros(len(r))
    z = (r - r.mean()) / sd
    return z - 0.5 * (r.mean() / sd) * (z * z - 1)


def sharpe_inference(r: np.ndarray, level: float = 0.95, lag: int | None = None, null: float = 0.0) -> dict:
    n = len(r)
    sd = r.std(ddof=1) if n > 1 else 0.0
    ratio = r.mean() / sd if sd > 0 else 0.0
    if n < 3 or sd == 0:
        return {"sharpe_ratio": ratio, "standard_error": math.nan, "lower": math.nan, "upper": math.nan, "test_statistic": math.nan, "p_value": math.nan, "significant": False, "lag": 0}
    lag = automatic_lag(n) if lag is None else lag
    se = math.sqrt(long_run_variance(sharpe_influence(r), lag) / n)
    z, t = norm_ppf(0.5 + level / 2), (ratio - null) / se
    p = math.erfc(abs(t) / math.sqrt(2))
    return {"sharpe_ratio": ratio, "standard_error": se, "lower": ratio - z * se, "upper": ratio + z * se, "test_statistic": t, "p_value": p, "significant": p < 1 - level, "lag": lag}


def sharpe_inferences(returns: DataFrame, value: str = "x", level: float = 0.95, lag: int | None = None, null: float = 0.0) -> DataFrame:
    """symbol and the inference of its Sharpe ratio from influences and their long-run variance, as one plan.

    Lags follow each series' length (or are given), and a row meets as many before it as the longest series has.
    Series of fewer than three rows, or without deviation, have a ratio and nothing else.
    """
    o = ordered("symbol", "ts")
    rows = returns.filter(F.col("symbol").isNotNull() & F.col(value).isNotNull()).select("symbol", "ts", F.col(value).alias("_x"))
    stats = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_sd"))
    lags = F.greatest(F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))), F.lit(1)).cast("long") if lag is None else F.lit(lag).cast("long")
    good = (F.col("n") >= 3) & (F.col("_sd") > 0)
    stats = stats.withColumn("sharpe_ratio", F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd")).otherwise(0.0)).withColumn("lag", F.when(good, lags).otherwise(F.lit(0)).cast("long"))
    most = stats.agg(F.max(F.least("lag", F.col("n") - 1))).first()[0] or 0
    z = (F.col("_x") - F.col("_m")) / F.col("_sd")
    infl = rows.join(stats.filter(good), "symbol").withColumn("_i", z - 0.5 * F.col("sharpe_ratio") * (z * z - 1))
    infl = infl.join(infl.groupBy("symbol").agg(F.avg("_i").alias("_mi")), "symbol").withColumn("_i", F.col("_i") - F.col("_mi"))
    past = F.reverse(F.collect_list("_i").over(o.rowsBetween(-int(most), -1))) if most else F.array().cast("array<double>")
    weighted = F.aggregate(F.transform(F.col("_past"), lambda v, k: F.when(k + 1 <= F.col("lag"), v * (1 - (k + 1) / (F.col("lag") + 1.0))).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    infl = infl.withColumn("_past", past).withColumn("_c", F.col("_i") * (F.col("_i") + 2 * weighted))
    variance = infl.groupBy("symbol").agg(F.greatest(F.sum("_c") / F.count(F.lit(1)), F.lit(1e-12)).alias("_v"))
    out = stats.join(variance, "symbol", "left").withColumn("standard_error", F.sqrt(F.col("_v") / F.col("n")))
    width = norm_ppf(0.5 + level / 2)
    out = out.withColumns({"lower": F.col("sharpe_ratio") - width * F.col("standard_error"), "upper": F.col("sharpe_ratio") + width * F.col("standard_error"), "test_statistic": (F.col("sharpe_ratio") - null) / F.col("standard_error")})
    out = out.withColumn("p_value", 2 * phi("-abs(test_statistic)")).withColumn("significant", F.coalesce(F.col("p_value") < 1 - level, F.lit(False)))
    return out.select("symbol", "sharpe_ratio", "standard_error", "lower", "upper", "test_statistic", "p_value", "significant", "lag")


def newey_west(returns: DataFrame, lag: int, value: str = "x") -> DataFrame:
    """symbol, variance: the same in SQL, products with lagged values summed in one pass."""
    w = ordered("symbol", "ts")
    c = returns.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy("symbol")))
    c = c.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lag + 1)})
    total = F.sum(F.col("_c") * F.col("_c"))
    for k in range(1, lag + 1):
        total = total + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0))
    return c.groupBy("symbol").agg(F.greatest(total / F.count(F.lit(1)), F.lit(1e-12)).alias("variance"))


def _difference(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Difference of Sharpe ratios and its influence function."""
    parts = []
    for r in (a, b):
        m, g = r.mean(), (r * r).mean()
        s = math.sqrt(max(g - m * m, 1e-300))
        parts.append((m / s, g / s**3 * (r - m) - m / (2 * s**3) * (r * r - g)))
    return parts[0][0] - parts[1][0], parts[0][1] - parts[1][1]


def sharpe_difference(a: np.ndarray, b: np.ndarray, method: str = "ledoit_wolf", block: int | None = None, draws: int = 1000, bandwidth: int | None = None, seed: int = 0) -> dict:
    if method not in ("ledoit_wolf", "naive") or len(a) != len(b):
        raise ValueError("method is ledoit_wolf or naive, and both series have one length")
    n = len(a)
    delta, influence = _difference(a, b)
    if method == "naive":
        se = math.sqrt(long_run_variance(influence, 0, 1e-300) / n)
        stat = delta / se
        p = math.erfc(abs(stat) / math.sqrt(2))
        return {"delta": delta, "se": se, "stat": stat, "pvalue": p, "reject": p < 0.05}
    block = block or max(1, math.ceil(round(n ** (1 / 3), 12)))
    band = bandwidth or block
    se = math.sqrt(long_run_variance(influence, band, 1e-300) / n)
    stat = abs(delta / se)
    rng = np.random.default_rng(seed)
    beyond = 0
    for _ in range(draws):
        at = (rng.integers(0, n, -(-n // block))[:, None] + np.arange(block)).ravel()[:n] % n
        d, i = _difference(a[at], b[at])
        beyond += abs((d - delta) / math.sqrt(long_run_variance(i, band, 1e-300) / n)) >= stat
    p = (beyond + 1) / (draws + 1)
    return {"delta": delta, "se": se, "stat": stat, "pvalue": p, "reject": p < 0.05}


def sharpe_differences(pairs: DataFrame, **parameters) -> DataFrame:
    """symbol and the test of columns a and b."""
    return per_series(pairs.select("symbol", "ts", "a", "b"), "symbol", ["ts"], lambda rows: scalars(**sharpe_difference(rows["a"].to_numpy(float), rows["b"].to_numpy(float), **parameters)), "delta double, se double, stat double, pvalue double, reject boolean")


def sharpe_difference_tests(pairs: DataFrame, band: int | None = None) -> DataFrame:
    """symbol, delta, se, stat, pvalue, reject: the test of columns a and b against the normal distribution, as one plan.

    The standard error is that of the difference's influences with Bartlett weights over band lags: 0 takes rows as
    independent, None the cube root of each series' length.  Rows that lack a value are left out; where a series has
    no deviation, delta and what follows from it are null and nothing is rejected.
    """
    whole = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = pairs.select("symbol", "ts", whole("a").alias("a"), whole("b").alias("b")).filter("symbol IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    stats = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[f(e).alias(c + k) for c in "ab" for k, f, e in (("m", F.avg, F.col(c)), ("g", F.avg, F.col(c) * F.col(c)), ("s", F.stddev_pop, F.col(c)))])
    stats = stats.withColumn("lag", (F.ceil(F.round(F.pow("n", F.lit(1 / 3)), 12)) if band is None else F.lit(band)).cast("long"))
    good = stats.filter((F.col("as") > 0) & (F.col("bs") > 0))
    most = stats.agg(F.max(F.least("lag", F.col("n") - 1))).first()[0] or 0
    of = lambda c: F.col(f"{c}g") / F.pow(f"{c}s", F.lit(3)) * (F.col(c) - F.col(f"{c}m")) - F.col(f"{c}m") / (2 * F.pow(f"{c}s", F.lit(3))) * (F.col(c) * F.col(c) - F.col(f"{c}g"))
    infl = rows.join(good, "symbol").select("symbol", "ts", "lag", (of("a") - of("b")).alias("_i"))
    past = F.reverse(F.collect_list("_i").over(ordered("symbol", "ts").rowsBetween(-int(most), -1))) if most else F.array().cast("array<double>")
    weighted = F.aggregate(F.transform("_past", lambda v, k: F.when(k < F.col("lag"), v * (1 - (k + 1) / (F.col("lag") + 1.0))).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    variance = infl.withColumn("_past", past).groupBy("symbol").agg(F.greatest(F.avg(F.col("_i") * (F.col("_i") + 2 * weighted)), F.lit(1e-300)).alias("_v"))
    out = stats.join(variance, "symbol", "left").withColumns({"delta": F.when(F.col("_v").isNotNull(), F.col("am") / F.col("as") - F.col("bm") / F.col("bs")), "se": F.sqrt(F.col("_v") / F.col("n"))})
    out = out.withColumn("stat", F.col("delta") / F.col("se")).withColumn("pvalue", 2 * phi("-abs(stat)"))
    return out.select("symbol", "delta", "se", "stat", "pvalue", F.coalesce(F.col("pvalue") < 0.05, F.lit(False)).alias("reject"))


def sharpe_denominator_sql(sr: str, skew: str, kurt: str) -> str:
    return f"(1e0 - {skew} * {sr} + ({kurt} - 1e0) / 4e0 * {sr} * {sr})"


def psr_z_sql(sr: str, benchmark: str, n: str, skew: str = "0e0", kurt: str = "3e0") -> str:
    """Null where the denominator isn't positive."""
    d = sharpe_denominator_sql(sr, skew, kurt)
    return f"(CASE WHEN {d} > 0e0 THEN ({sr} - {benchmark}) * sqrt({n} - 1e0) / sqrt({d}) END)"


def psr_sql(sr: str, benchmark: str, n: str, skew: str = "0e0", kurt: str = "3e0") -> str:
    return f"coalesce({phi_sql(psr_z_sql(sr, benchmark, n, skew, kurt))}, 0e0)"


def probabilistic_sharpe_ratio(sr: float, benchmark: float, n: int, skew: float = 0.0, kurt: float = 3.0, statistic: bool = False) -> float:
    d = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    z = (sr - benchmark) * math.sqrt(n - 1) / math.sqrt(d) if d > 0 else -math.inf
    return z if statistic else norm_cdf(z)


def expected_max(n: float, mean: float, sd: float, gamma: float = 0.5772156649) -> float:
    """Expected greatest of n normal draws; gamma is cut as the published results have it."""
    if n < 1:
        return 0.0
    return mean if n == 1 else mean + sd * ((1 - gamma) * norm_ppf(1 - 1 / n) + gamma * norm_ppf(1 - 1 / (n * math.e)))


def benchmark_sharpe(ratios) -> float:
    r = np.asarray(ratios, float)
    return 0.0 if not len(r) else float(r[0]) if len(r) == 1 else expected_max(len(r), 0.0, float(r.std()), EULER)


def benchmark_sharpes(ratios: DataFrame, value: str = "sr") -> DataFrame:
    """One row, benchmark: the expected greatest of as many ratios of no mean as there are; one ratio is its own, none
    gives 0."""
    known = ratios.filter(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_pop(value).alias("sd"), F.max(value).alias("only"))
    top = (1 - EULER) * phi_inv("1e0 - 1e0 / n") + EULER * phi_inv(f"1e0 - 1e0 / (n * {math.e!r})")
    return known.select(F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("only")).otherwise(F.col("sd") * top).alias("benchmark"))


def sharpe_z(sr: float, n: int, true: float = 0.0, skew: float = 0.0, kurt: float = 3.0) -> float:
    d = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return (sr - true) * math.sqrt(n - 1) / math.sqrt(d) if d > 0 else math.nan


def type1_error(z: float, k: int = 1) -> float:
    return 1 - (1 - norm_cdf(-z)) ** k


def theta_for_type2(sr: float, n: int, true: float, skew: float = 0.0, kurt: float = 3.0) -> float:
    d = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return true * math.sqrt(n - 1) / math.sqrt(d) if d > 0 else math.nan


def type2_error(alpha: float, k: int, theta: float) -> float:
    return norm_cdf(norm_ppf((1 - alpha) ** (1 / k)) - theta)


def simulate_max_sharpe(spark: SparkSession, simulations: int, trials: list[int], sd: float = 1.0, mean: float = 0.0, seed: int = 1) -> DataFrame:
    """sim, n_trials, max_sr: trials are rows with a seeded normal, reduced by max; ids make it the same in each run."""
    rows = spark.range(simulations).withColumnRenamed("id", "sim").withColumn("n_trials", F.explode(F.array(*map(F.lit, trials))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_trials"))))
    # a normal from two hashed uniforms: independent of partitioning
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "sim", "n_trials", "k"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(2))
    draws = rows.withColumn("z", normal)
    g = draws.groupBy("sim", "n_trials").agg(F.max("z").alias("top"), F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    return g.select("sim", "n_trials", (mean + sd * F.try_divide(F.col("top") - F.col("m"), F.col("s"))).alias("max_sr"))


def mean_std_error(spark: SparkSession, simulations: int, batches: int, trials: list[int], sd: float = 1.0, mean: float = 0.0, seed: int = 1) -> DataFrame:
    """n_trials, mean_error, std_error of batch means against the expected maximum."""
    sims = simulate_max_sharpe(spark, simulations * batches, trials, sd, mean, seed)
    expected = spark.createDataFrame([(n, expected_max(n, mean, sd)) for n in trials], "n_trials int, expected double")
    b = sims.groupBy("n_trials", F.floor(F.col("sim") / simulations).alias("batch")).agg(F.avg("max_sr").alias("avg"))
    e = b.join(F.broadcast(expected), "n_trials").withColumn("e", F.try_divide("avg", F.col("expected")) - 1)
    return e.groupBy("n_trials").agg(F.avg("e").alias("mean_error"), F.stddev_samp("e").alias("std_error"))


# ---- strategy risk ---------------------------------------------------------------------------------


def binomial_variance(p: float, up: float, down: float) -> float:
    return p * (1 - p) * (up - down) ** 2


def implied_precision(loss: float, profit: float, frequency: float, target: float) -> float:
    width = profit - loss
    a = (frequency + target**2) * width**2
    b = (2 * frequency * loss - target**2 * width) * width
    rest = b * b - 4 * a * frequency * loss**2
    return math.nan if rest < 0 else (math.sqrt(rest) - b) / (2 * a)


def implied_frequency(loss: float, profit: float, p: float, target: float) -> float:
    width, edge = profit - loss, (profit - loss) * p + loss
    return (target * width) ** 2 * p * (1 - p) / edge**2 if 0 < p < 1 and edge else math.inf


def binomial_sharpe(loss: float, profit: float, frequency: float, p: float) -> float:
    mean, sd = profit * p + loss * (1 - p), (profit - loss) * math.sqrt(p * (1 - p))
    if sd == 0:
        return 0.0 if mean == 0 else math.copysign(math.inf, mean)
    return mean / sd * math.sqrt(frequency)


def sharpe_trials(p: float, n: int, seed: int = 1) -> tuple[float, float, float]:
    x = np.where(np.random.default_rng(seed).random(n) < p, 1.0, -1.0)
    return float(x.mean()), float(x.std()), float(x.mean() / x.std()) if x.std() else 0.0


def mixed_gaussians(m1: float, m2: float, s1: float, s2: float, p: float, n: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = int(n * p)
    return rng.permutation(np.concatenate([rng.normal(m1, s1, k), rng.normal(m2, s2, n - k)]))


def failure_columns(returns: DataFrame, frequency: float, target: float, value: str = "x") -> DataFrame:
    """symbol, failure: normal score of the observed against the needed share of gains, as asserted of the source."""
    x = F.col(value)
    s = returns.groupBy("symbol").agg(F.avg(F.when(x > 0, x)).alias("u"), F.abs(F.avg(F.when(x <= 0, x))).alias("l"), F.avg((x > 0).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    width = F.col("u") - F.col("l")
    s = s.withColumn("a", (frequency + target**2) * width * width).withColumn("b", (2 * frequency * F.col("l") - target**2 * width) * width).withColumn("rest", F.col("b") * F.col("b") - 4 * F.col("a") * frequency * F.col("l") * F.col("l"))
    s = s.withColumn("need", F.when(F.col("rest") >= 0, F.try_divide(F.sqrt(F.greatest("rest", F.lit(0.0))) - F.col("b"), 2 * F.col("a"))))
    s = s.withColumn("z", F.try_divide(F.col("p") - F.col("need"), F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))))
    return s.select("symbol", F.when(F.col("u").isNull() | F.col("l").isNull(), F.lit(0.0)).when(F.col("need").isNull(), F.lit(1.0)).otherwise(phi("z")).alias("failure"))


def failure_probability(r: np.ndarray, frequency: float, target: float) -> float:
    up, down = r[r > 0], r[r <= 0]
    if not len(up) or not len(down):
        return 0.0
    p, need = len(up) / len(r), implied_precision(abs(down.mean()), up.mean(), frequency, target)
    return 1.0 if math.isnan(need) else norm_cdf((p - need) / math.sqrt(p * (1 - p) / len(r)))


def strategy_risk(m1, m2, s1, s2, p, n, frequency, target, seed: int = 1) -> float:
    return failure_probability(mixed_gaussians(m1, m2, s1, s2, p, n, seed), frequency, target)


# ---- bet sizing ------------------------------------------------------------------------------------


def probability_bet_size(probability: str, side: str) -> Column:
    return F.col(side) * (2 * phi(probability) - 1)


def concurrent_average(dates: DataFrame, bets: DataFrame) -> DataFrame:
    """symbol, at, size: mean size of bets with start <= at <= end; 0 where there are none."""
    w = Window.partitionBy("symbol").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    rows = bets.select("symbol", F.col("start").alias("at"), F.lit(0).alias("o"), F.lit(1).alias("n"), F.col("size").alias("v"))
    rows = rows.unionByName(bets.select("symbol", F.col("end").alias("at"), F.lit(2).alias("o"), F.lit(-1).alias("n"), (-F.col("size")).alias("v")))
    rows = rows.unionByName(dates.select("symbol", "at", F.lit(1).alias("o"), F.lit(0).alias("n"), F.lit(0.0).alias("v")))
    return rows.withColumn("c", F.sum("n").over(w)).withColumn("t", F.sum("v").over(w)).filter("o = 1").select("symbol", "at", F.coalesce(F.try_divide("t", F.col("c")), F.lit(0.0)).alias("size"))


def active_average(signals: DataFrame) -> DataFrame:
    """symbol, at, signal: mean of signals open in [start, end), a null end staying open; 0 without any."""
    s = delta_sweep(signals, "symbol", "start", "end", "signal")
    return s.select("symbol", "at", F.when(F.col("n") > 0, F.try_divide("total", F.col("n"))).otherwise(F.lit(0.0)).alias("signal"))


def discrete(x: Column, step: float) -> Column:
    """Nearest multiple of step, halves to even, within [-1, 1]."""
    return F.greatest(F.least(F.rint(x / step) * step, F.lit(1.0)), F.lit(-1.0))


def generate_signals(bets: DataFrame, classes: int, step: float) -> DataFrame:
    """symbol, at, signal from start, end, probability, prediction and, if there, side."""
    t = F.try_divide(F.col("probability") - 1.0 / classes, F.sqrt(F.col("probability") * (1 - F.col("probability"))))
    sized = bets.withColumn("_t", t)
    signal = F.col("prediction") * (2 * phi("_t") - 1) * (F.col("side") if "side" in bets.columns else F.lit(1.0))
    return active_average(sized.withColumn("signal", signal)).withColumn("signal", discrete(F.col("signal"), step))


def sigmoid_size(w: Column, x: Column) -> Column:
    return x / F.sqrt(w + x * x)


def target_position(w: Column, forecast: Column, price: Column, most: Column) -> Column:
    return (sigmoid_size(w, forecast - price) * most).cast("int")


def inverse_price(f: Column, w: Column, m: Column) -> Column:
    return F.when(F.abs(m) == 1.0, f).otherwise(f - m * F.sqrt(F.try_divide(w, 1 - m * m)))


def sigmoid_width(x: Column, m: Column) -> Column:
    return F.when((m == 0) | (F.abs(m) == 1), F.lit(float("inf"))).otherwise(x * x * (F.try_divide(F.lit(1.0), m * m) - 1))


def limit_price(target: Column, current: Column, f: Column, w: Column, most: Column) -> Column:
    """Mean inverse price over the sizes moved through; an empty range of sizes gives 0."""
    s = F.signum(target - current)
    lo, hi = F.abs(current + s).cast("int"), F.abs(target + s).cast("int") - 1
    sizes = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, i: acc + inverse_price(f, w, i / most))
    return F.when(target == current, f).otherwise(F.try_divide(total, F.abs(target - current)))


def concurrent_sides(signals: DataFrame) -> DataFrame:
    """symbol, at, long, short: open signals by sign at each change."""
    side = lambda c: F.when(c, F.lit(1.0)).otherwise(0.0)
    up = delta_sweep(signals.withColumn("v", side(F.col("signal") > 0)), "symbol", "start", "end", "v").select("symbol", "at", F.col("total").alias("long"))
    down = delta_sweep(signals.withColumn("v", side(F.col("signal") < 0)), "symbol", "start", "end", "v").select("symbol", "at", F.col("total").alias("short"))
    return up.join(down, ["symbol", "at"])


def mixture_cdf(x: str, m1: float, s1: float, m2: float, s2: float, p: float) -> Column:
    return p * phi(f"(({x}) - ({m1})) / ({s1})") + (1 - p) * phi(f"(({x}) - ({m2})) / ({s2})")


def gaussian_bet(x: str, m1: float, s1: float, m2: float, s2: float, p: float) -> Column:
    """Bet size from a two-Gaussian fit of concurrency: how far its mass at 0 has been left behind."""
    at, zero = mixture_cdf(x, m1, s1, m2, s2, p), mixture_cdf("0e0", m1, s1, m2, s2, p)
    return F.when(F.col(x) >= 0, F.try_divide(at - zero, 1 - zero)).otherwise(F.try_divide(at - zero, zero))


# ---- multiple testing ------------------------------------------------------------------------------


def sharpe_p_value(sr: str, periods: str) -> Column:
    return phi(f"-({sr}) * sqrt({periods})")


def holm(tests: DataFrame, p: str = "p", key: str = "symbol", tie: str = "strategy") -> DataFrame:
    """tests with holm: running maximum of (M - rank + 1) p, at most 1."""
    w = Window.partitionBy(key).orderBy(p, tie)
    raw = (F.count(F.lit(1)).over(Window.partitionBy(key)) - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("_h", raw).withColumn("holm", F.least(F.max("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_h")


def bhy(tests: DataFrame, p: str = "p", key: str = "symbol", tie: str = "strategy") -> DataFrame:
    """tests with bhy: minimum from the largest p down of c(M) M p / rank, at most 1."""
    w = Window.partitionBy(key).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(key))
    harmonic = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k)
    raw = tests.withColumn("_m", m).withColumn("_b", harmonic * m * F.col(p) / F.row_number().over(w))
    return raw.withColumn("bhy", F.least(F.min("_b").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_m", "_b")


def haircut_sharpe(tests: DataFrame, periods: float, method: str = "holm", alpha: float = 0.05, sr: str = "sr", key: str = "symbol", tie: str = "strategy") -> DataFrame:
    """tests with p, adjusted p, haircut ratio and whether the test is significant."""
    if method not in ("holm", "bhy"):
        raise ValueError("method is holm or bhy")
    t = tests.withColumn("_n", F.lit(float(periods))).withColumn("p", sharpe_p_value(sr, "_n"))
    t = (holm if method == "holm" else bhy)(t, "p", key, tie).withColumnRenamed(method, "adjusted")
    kept = t.withColumn("_q", 1 - F.greatest(F.least("adjusted", F.lit(1 - 1e-15)), F.lit(1e-15)))
    return kept.withColumn("haircut", phi_inv("_q") / F.sqrt("_n")).withColumn("significant", F.col("adjusted") <= alpha).drop("_n", "_q")


