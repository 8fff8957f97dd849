"""Synthetic prices: bursts of drift and volatility, stochastic volatility with jumps, regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship

KEYS = ("mu", "kappa", "theta", "xi", "rho", "lam", "m", "v")


def burst(spark: SparkSession, n: int, a: tuple[float, float], b: tuple[float, float], alpha: float, beta: float, width: float = 0.1) -> DataFrame:
    """id, drift, volatility: they grow towards the middle and are flat within `width` of it.

    At the middle itself the drift is 0 and the volatility that of the step before.
    """
    s = F.col("id") / F.lit(float(n - 1))
    r = spark.range(n).select("id", s.alias("s"))
    gap = F.when(F.abs(F.col("s") - 0.5) <= width, F.lit(width)).otherwise(F.abs(F.col("s") - 0.5))
    early, middle = F.col("s") <= 0.5, F.col("s") == 0.5
    r = r.withColumn("_g", gap).withColumn("drift", F.when(middle, 0.0).otherwise(F.when(early, a[0]).otherwise(a[1]) / F.pow("_g", F.lit(alpha))))
    r = r.withColumn("_v", F.when(middle, F.lit(None)).otherwise(F.when(early, b[0]).otherwise(b[1]) / F.pow("_g", F.lit(beta))))
    back = F.last("_v", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("volatility", F.coalesce(back, F.lit(float(b[0])))).select("id", "drift", "volatility")


def log_returns(mu, kappa, theta, xi, z_price, z_vol, jumps, counts, dt, lam, m, v, changes) -> np.ndarray:
    """Steps of a Heston variance with compensated jumps; a regime change sets the variance to its mean."""
    n = len(mu)
    out, var, root = np.empty(n), theta[0], np.sqrt(dt)
    for k in range(n):
        var = theta[k] if changes[k] else var
        safe = max(var, 0.0)
        out[k] = (mu[k] - safe / 2 - lam[k] * (m[k] + v[k] ** 2 / 2)) * dt + np.sqrt(safe) * z_price[k] * root + counts[k] * jumps[k]
        var += kappa[k] * (theta[k] - safe) * dt + xi[k] * np.sqrt(safe) * z_vol[k] * root
    return out


def aligned(parameters: dict) -> tuple[dict, int]:
    """Scalars repeated and short lists padded by their last value to one length; longer ones are cut to it."""
    lists = {k: list(v) if np.ndim(v) else [v] for k, v in parameters.items()}
    n = max(map(len, lists.values()))
    return {k: (v + v[-1:] * n)[:n] for k, v in lists.items()}, n


def heston_merton(parameters: dict, n: int, dt: float, changes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    p = {k: np.asarray(v, float) for k, v in parameters.items()}
    z1 = rng.standard_normal(n)
    z2 = p["rho"] * z1 + np.sqrt(1 - p["rho"] ** 2) * rng.standard_normal(n)
    return log_returns(p["mu"], p["kappa"], p["theta"], p["xi"], z1, z2, p["m"] + p["v"] * rng.standard_normal(n), rng.poisson(p["lam"] * dt), dt, p["lam"], p["m"], p["v"], changes)


def regime_path(transition: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    u, path = rng.random(n), np.zeros(n, int)
    edges = np.cumsum(transition, 1)
    for k in range(1, n):
        path[k] = min(int(np.searchsorted(edges[path[k - 1]], u[k])), len(transition) - 1)
    return path


def prices_from_regimes(regimes: dict, transition: np.ndarray, years: float, steps: int, seed: int = 0) -> tuple[np.ndarray, list[str]]:
    """Prices from 100 and the regime of each step; parameter lists run through a regime's spells."""
    rng = np.random.default_rng(seed)
    names = list(regimes)
    full = {k: aligned(v)[0] for k, v in regimes.items()}
    path = regime_path(np.asarray(transition, float), steps, rng)
    spell = np.zeros(steps, int)
    for k in range(1, steps):
        spell[k] = spell[k - 1] + 1 if path[k] == path[k - 1] else 0
    at = {p: [full[names[r]][p][min(s, len(full[names[r]][p]) - 1)] for r, s in zip(path, spell)] for p in KEYS}
    changes = np.concatenate([[False], path[1:] != path[:-1]])
    return 100 * np.exp(np.cumsum(heston_merton(at, steps, years / steps, changes, rng))), [names[r] for r in path]


def simulate_prices(spark: SparkSession, paths: int, regimes: dict, transition, years: float, steps: int, seed: int = 0) -> DataFrame:
    """path, step, price, regime: paths are rows, each generated on its own from its number."""
    ship(spark)
    t = np.asarray(transition, float)

    def run(batches):
        for b in batches:
            for k in b["id"]:
                price, names = prices_from_regimes(regimes, t, years, steps, seed + 7919 * int(k))
                yield pd.DataFrame({"path": int(k), "step": np.arange(steps), "price": price, "regime": names})

    return spark.range(paths).repartition(min(paths, 64)).mapInPandas(run, "path long, step long, price double, regime string")


def random_cov(n: int, factors: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((n, factors))
    return w @ w.T + np.diag(rng.random(n))


def true_matrix(blocks: int, size: int, rho: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance) of shuffled block assets with random volatilities."""
    rng = np.random.default_rng(seed)
    corr = np.kron(np.eye(blocks), np.full((size, size), rho))
    np.fill_diagonal(corr, 1.0)
    order = rng.permutation(len(corr))
    s = rng.uniform(0.05, 0.2, len(corr))
    return rng.normal(s, s), np.outer(s, s) * corr[np.ix_(order, order)]


def sampled_moments(mu: np.ndarray, cov: np.ndarray, n: int, seed: int = 0, shrink: bool = False) -> tuple[np.ndarray, np.ndarray]:
    if shrink:
        raise ValueError("shrinkage is not offered")
    x = np.random.default_rng(seed).multivariate_normal(mu, cov, n)
    return x.mean(0), np.cov(x.T)
