"""Ornstein-Uhlenbeck trading rules in closed form, by simulation, and the fit of the process."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import ordered
from ..functions.special import erfi
from ..runtime import ship

_erfi = np.vectorize(erfi, otypes=[float])


def theta_from_half_life(h: float) -> float:
    return math.log(2) / h


def stationary_std(theta: float, sigma: float) -> float:
    return sigma / math.sqrt(2 * theta)


def _scale(points: np.ndarray, a: float, c: float, top: float) -> np.ndarray:
    """Integral from a to each point of exp(c s^2 - c top): exact by erfi, else by the trapezoid rule."""
    r = math.sqrt(c)
    with np.errstate(over="ignore", invalid="ignore"):
        v = math.sqrt(math.pi) / (2 * r) * (_erfi(r * points) - erfi(r * a)) * math.exp(-c * top)
    if np.isfinite(v).all():
        return v
    out = []
    for p in points:
        s = np.linspace(a, p, 3000)
        out.append(np.trapezoid(np.exp(c * (s * s - top)), s))
    return np.array(out)


def hit_upper(gap: float, profit: float, loss: float, theta: float, sigma: float) -> float:
    """Chance of the upper barrier first, starting `gap` below the mean."""
    c, y0 = theta / sigma**2, -gap
    a, b = y0 - loss, y0 + profit
    if b <= a:
        return math.nan
    part, whole = _scale(np.array([y0, b]), a, c, max(a * a, b * b))
    return min(max(part / whole, 0.0), 1.0) if whole > 0 else math.nan


def mean_exit_time(gap: float, profit: float, loss: float, theta: float, sigma: float) -> float:
    """Expected time to either barrier: Green's function times speed density over 400 nodes (3000 in the far tails)."""
    c, y0 = theta / sigma**2, -gap
    a, b = y0 - loss, y0 + profit
    if b <= a:
        return math.nan
    r = math.sqrt(c)
    far = max(abs(a), abs(b)) * r > 26
    top = max(a * a, b * b) if far else 0.0
    y = np.linspace(a, b, 3000 if far else 400)
    # integrals from a up to a node and from it up to b, each by itself: their sum would drown the smaller
    if far:
        s = _scale(np.append(y, y0), a, c, top)
        below, at, whole = s[:-1], s[-1], s[len(y) - 1]
        above, rest = whole - below, whole - at
    else:
        e, unit = _erfi(r * np.append(y, y0)), math.sqrt(math.pi) / (2 * r)
        below, above = unit * (e[:-1] - e[0]), unit * (e[len(y) - 1] - e[:-1])
        at, rest, whole = unit * (e[-1] - e[0]), unit * (e[len(y) - 1] - e[-1]), unit * (e[len(y) - 1] - e[0])
    green = np.where(y <= y0, below * rest, at * above) / whole
    return float(np.trapezoid(green * 2 / sigma**2 * np.exp(c * (top - y * y)), y))


def rule_metrics(profit: float, loss: float, theta: float, sigma: float, gap: float, cost: float = 0.0) -> dict:
    bad = {"hit_probability": math.nan, "expected_gain": -math.inf, "std_gain": math.nan, "expected_holding_time": math.nan, "return_rate": -math.inf, "time_scaled_sharpe": -math.inf}
    if profit <= 0 or loss <= 0:
        return bad
    u, t = hit_upper(gap, profit, loss, theta, sigma), mean_exit_time(gap, profit, loss, theta, sigma)
    if not math.isfinite(u) or not math.isfinite(t) or t <= 0:
        return bad
    gain, sd = profit * u - loss * (1 - u) - cost, (profit + loss) * math.sqrt(max(u * (1 - u), 0))
    return {"hit_probability": u, "expected_gain": gain, "std_gain": sd, "expected_holding_time": t, "return_rate": gain / t, "time_scaled_sharpe": gain / (sd * math.sqrt(t)) if sd > 0 else -math.inf}


def metrics_grid(spark: SparkSession, profits: list[float], losses: list[float], theta: float, sigma: float, gap: float, cost: float = 0.0) -> DataFrame:
    """profit, loss and the rule's metrics; the grid is rows."""
    ship(spark)
    names = ["hit_probability", "expected_gain", "std_gain", "expected_holding_time", "return_rate", "time_scaled_sharpe"]

    def run(batches):
        for b in batches:
            m = pd.DataFrame([rule_metrics(p, q, theta, sigma, gap, cost) for p, q in zip(b["profit"], b["loss"])])
            yield pd.concat([b.reset_index(drop=True), m[names].replace([np.inf, -np.inf], np.nan)], axis=1)

    grid = spark.createDataFrame([(float(p), float(q)) for p in profits for q in losses], "profit double, loss double")
    return grid.repartition(8).mapInPandas(run, "profit double, loss double, " + ", ".join(f"{n} double" for n in names))


def optimal_rule(spark: SparkSession, theta: float, sigma: float, gap: float, cost: float = 0.0, bounds: tuple[float, float] = (0.25, 4.0), points: int = 21, rounds: int = 4) -> dict:
    """The rule of the greatest return rate: grids that close in on their best cell."""
    lo, hi = [bounds[0]] * 2, [bounds[1]] * 2
    for _ in range(rounds):
        axes = [np.linspace(a, b, points).tolist() for a, b in zip(lo, hi)]
        best = metrics_grid(spark, *axes, theta, sigma, gap, cost).orderBy(F.desc_nulls_last("return_rate"), "profit", "loss").first()
        step = [(b - a) / (points - 1) for a, b in zip(lo, hi)]
        at = [best["profit"], best["loss"]]
        lo = [max(bounds[0], x - s) for x, s in zip(at, step)]
        hi = [min(bounds[1], x + s) for x, s in zip(at, step)]
    return {"profit_take": at[0], "stop_loss": at[1], **rule_metrics(*at, theta, sigma, gap, cost)}


def fit_process(series: DataFrame, dt: float = 1.0, value: str = "x") -> DataFrame:
    """symbol, theta, sigma, mu, rho, half_life, stationary_std, r2 from the regression on the value before."""
    w = ordered("symbol", "ts")
    s = series.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_x0", F.lag(value).over(w)).filter(F.col("_x0").isNotNull())
    g = s.groupBy("symbol").agg(F.expr(f"regr_slope({value}, _x0)").alias("b0"), F.expr(f"regr_intercept({value}, _x0)").alias("a"), F.expr(f"regr_syy({value}, _x0)").alias("syy"), F.expr(f"regr_sxy({value}, _x0)").alias("sxy"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("rho", F.greatest(F.least("b0", F.lit(0.999999)), F.lit(1e-6))).withColumn("theta", -F.ln("rho") / dt).withColumn("rss", F.col("syy") - F.col("b0") * F.col("sxy"))
    sigma = F.sqrt(F.try_divide(F.col("rss"), F.col("n") - 2) * 2 * F.col("theta") / (1 - F.col("rho") * F.col("rho")))
    g = g.withColumn("sigma", sigma)
    return g.select("symbol", "theta", "sigma", (F.col("a") / (1 - F.col("rho"))).alias("mu"), "rho", (math.log(2) / F.col("theta")).alias("half_life"), (F.col("sigma") / F.sqrt(2 * F.col("theta"))).alias("stationary_std"), F.coalesce(1 - F.try_divide("rss", F.col("syy")), F.lit(0.0)).alias("r2"))


def synthetic_backtest(spark: SparkSession, forecast: float, half_life: float, sigma: float, profits: list[float], losses: list[float], paths: int = 10_000, longest: int = 100, seed_price: float = 0.0, seed: int = 1) -> DataFrame:
    """profit, loss, mean, std, sharpe over simulated exits: cells times chunks of paths are rows, moments are summed by Spark."""
    ship(spark)
    rho, chunk = 2 ** (-1 / half_life), 2000
    rows = [(float(p), float(q), k, min(chunk, paths - k * chunk)) for p in profits for q in losses for k in range(-(-paths // chunk))]

    def run(batches):
        for b in batches:
            out = []
            for p, q, k, n in b.itertuples(index=False):
                rng = np.random.default_rng([seed, int(p * 1e6), int(q * 1e6), int(k)])
                price, gain, held = np.full(n, seed_price), np.zeros(n), np.ones(n, bool)
                for step in range(1, longest + 2):
                    z = rng.standard_normal(n)
                    price = np.where(held, (1 - rho) * forecast + rho * price + sigma * z, price)
                    gain = price - seed_price
                    held &= ~((gain > p) | (gain < -q) | (step > longest))
                    if not held.any():
                        break
                out.append((p, q, n, gain.sum(), (gain * gain).sum()))
            yield pd.DataFrame(out, columns=["profit", "loss", "n", "s", "q"])

    sums = spark.createDataFrame(rows, "profit double, loss double, k int, n int").repartition(min(len(rows), 64)).mapInPandas(run, "profit double, loss double, n long, s double, q double")
    g = sums.groupBy("profit", "loss").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return g.select("profit", "loss", "mean", sd.alias("std"), F.coalesce(F.try_divide("mean", sd), F.lit(0.0)).alias("sharpe"))
