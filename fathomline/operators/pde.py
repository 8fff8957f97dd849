"""Nonlinear pricing equations, forward sampling as rows, and a deep backward solver in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


@dataclass
class Equation:
    """dX = mu X dt + sigma dW, with driver, Hamiltonian and terminal value.

    Each of those has a numpy form on (rows, dim) arrays and, where it is used at scale, a Column form.
    """

    dim: int
    total_time: float
    steps: int
    constants: dict = field(default_factory=dict)

    def __post_init__(self):
        self.dt = self.total_time / self.steps

    def start(self) -> np.ndarray:
        return np.full(self.dim, 100.0)

    def sigma(self, x):
        return self.constants["sigma"] * x

    def drift(self, x):
        return self.constants.get("mu_bar", 0.0) * x


class QuadraticControl(Equation):
    """Hamilton-Jacobi-Bellman equation of linear-quadratic control."""

    def start(self):
        return np.zeros(self.dim)

    def sigma(self, x):
        return np.full_like(x, np.sqrt(2.0))

    def driver(self, t, x, y, z):
        return np.zeros((len(x), 1))

    def hamiltonian(self, t, x, y, z):
        return (z**2).sum(1, keepdims=True) / 2.0

    def terminal(self, t, x):
        return np.log(0.5 * (1 + (x**2).sum(1, keepdims=True)))

    def terminal_column(self, x: Column) -> Column:
        return F.ln(0.5 * (1 + _sum(F.transform(x, lambda v: v * v))))


class UncertainVolatility(Equation):
    """Black-Scholes-Barenblatt equation."""

    def __post_init__(self):
        super().__post_init__()
        self.constants = {"sigma": 0.4, "rate": 0.05, "mu_bar": 0.0} | self.constants

    def start(self):
        return np.array([1.0 if k % 2 == 0 else 0.5 for k in range(self.dim)])

    def driver(self, t, x, y, z):
        return np.full((len(x), 1), self.constants["rate"])

    def hamiltonian(self, t, x, y, z):
        return -z.sum(1, keepdims=True) * self.constants["rate"] / self.constants["sigma"]

    def terminal(self, t, x):
        return (x**2).sum(1, keepdims=True)

    def terminal_column(self, x: Column) -> Column:
        return _sum(F.transform(x, lambda v: v * v))


class DefaultRisk(Equation):
    """Pricing with a hazard rate that falls linearly between two values."""

    def __post_init__(self):
        super().__post_init__()
        self.constants = {"sigma": 0.2, "rate": 0.02, "delta": 2 / 3, "high": 0.2, "low": 0.02, "mu_bar": 0.02, "v_high": 50.0, "v_low": 70.0} | self.constants

    def driver(self, t, x, y, z):
        c = self.constants
        slope = (c["high"] - c["low"]) / (c["v_high"] - c["v_low"])
        hazard = np.clip(c["high"] + np.maximum(y - c["v_high"], 0) * slope, c["low"], None)
        return (1 - c["delta"]) * hazard + c["rate"]

    def hamiltonian(self, t, x, y, z):
        return np.zeros((len(x), 1))

    def terminal(self, t, x):
        return np.maximum(x.min(1, keepdims=True), 0)

    def terminal_column(self, x: Column) -> Column:
        return F.greatest(F.array_min(x), F.lit(0.0))


class BorrowingRates(Equation):
    """Pricing with a lending rate and a higher borrowing rate."""

    def __post_init__(self):
        super().__post_init__()
        self.constants = {"sigma": 0.2, "mu_bar": 0.06, "lend": 0.04, "borrow": 0.06} | self.constants

    def _borrows(self, y, z):
        return z.sum(1, keepdims=True) / self.constants["sigma"] > y

    def driver(self, t, x, y, z):
        return np.where(self._borrows(y, z), self.constants["borrow"], self.constants["lend"])

    def hamiltonian(self, t, x, y, z):
        c = self.constants
        return (c["mu_bar"] - self.driver(t, x, y, z)) * z.sum(1, keepdims=True) / c["sigma"]

    def terminal(self, t, x):
        top = x.max(1, keepdims=True)
        return np.maximum(top - 120, 0) - 2 * np.maximum(top - 150, 0)

    def terminal_column(self, x: Column) -> Column:
        top = F.array_max(x)
        return F.greatest(top - 120, F.lit(0.0)) - 2 * F.greatest(top - 150, F.lit(0.0))


def sample(eq: Equation, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(increments n x dim x steps, states n x dim x steps + 1) by Euler steps."""
    dw = rng.standard_normal((n, eq.dim, eq.steps)) * np.sqrt(eq.dt)
    x = np.empty((n, eq.dim, eq.steps + 1))
    x[:, :, 0] = eq.start()
    for k in range(eq.steps):
        now = x[:, :, k]
        x[:, :, k + 1] = now + eq.drift(now) * eq.dt + eq.sigma(now) * dw[:, :, k]
    return dw, x


def sample_paths(spark: SparkSession, eq: Equation, n: int, seed: int = 0, chunk: int = 1000) -> DataFrame:
    """path, step, x, dw: chunks of paths are rows."""
    ship(spark)

    def run(batches):
        for b in batches:
            for c in b["id"]:
                m = min(chunk, n - int(c) * chunk)
                dw, x = sample(eq, m, np.random.default_rng([seed, int(c)]))
                for k in range(eq.steps + 1):
                    yield pd.DataFrame({"path": np.arange(m) + int(c) * chunk, "step": k, "x": list(x[:, :, k]), "dw": list(dw[:, :, k]) if k < eq.steps else [None] * m})

    return spark.range(-(-n // chunk)).repartition(min(-(-n // chunk), 64)).mapInPandas(run, "path long, step int, x array<double>, dw array<double>")


def terminal_values(paths: DataFrame, eq: Equation) -> DataFrame:
    return paths.filter(F.col("step") == eq.steps).select("path", eq.terminal_column(F.col("x")).alias("g"))


class _Net:
    """One hidden layer with hand-written gradients and Adam."""

    def __init__(self, n_in: int, n_hidden: int, n_out: int, rng: np.random.Generator):
        self.p = [rng.standard_normal((n_in, n_hidden)) / np.sqrt(n_in), np.zeros(n_hidden), rng.standard_normal((n_hidden, n_out)) * 0.1 / np.sqrt(n_hidden), np.zeros(n_out)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def forward(self, x):
        self.x, self.h = x, np.tanh(x @ self.p[0] + self.p[1])
        return self.h @ self.p[2] + self.p[3]

    def step(self, g: np.ndarray, rate: float) -> None:
        gh = g @ self.p[2].T * (1 - self.h**2)
        self.t += 1
        for k, d in enumerate((self.x.T @ gh, gh.sum(0), self.h.T @ g, g.sum(0))):
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            self.p[k] -= rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def solve(eq: Equation, hidden: int = 16, iterations: int = 200, batch: int = 128, init_y: float = 1.0, rate: float = 0.01, seed: int = 0) -> tuple[list[float], list[float]]:
    """(losses, initial values) of a backward solver: a net per step gives z, and y is carried to the end.

    The gradient of the terminal error with respect to y is taken as one through the steps, and that with
    respect to each z is its increment less the Hamiltonian's slope, by differences.
    """
    rng = np.random.default_rng(seed)
    nets = [_Net(eq.dim, hidden, eq.dim, rng) for _ in range(eq.steps)]
    y0, losses, inits = init_y, [], []
    scale = np.maximum(np.abs(eq.start()), 1.0)
    for _ in range(iterations):
        dw, x = sample(eq, batch, rng)
        y, slopes = np.full((batch, 1), y0), []
        for k, net in enumerate(nets):
            now = x[:, :, k]
            z = net.forward(now / scale)
            h = eq.hamiltonian(k * eq.dt, now, y, z)
            eps = 1e-4
            dh = np.hstack([(eq.hamiltonian(k * eq.dt, now, y, z + eps * np.eye(eq.dim)[j]) - h) / eps for j in range(eq.dim)])
            y = y + (eq.driver(k * eq.dt, now, y, z) * y + h) * eq.dt + (z * dw[:, :, k]).sum(1, keepdims=True)
            slopes.append(dw[:, :, k] + dh * eq.dt)
        miss = y - eq.terminal(eq.total_time, x[:, :, -1])
        losses.append(float((miss**2).mean()))
        g = 2 * miss / batch
        for net, s in zip(nets, slopes):
            net.step(g * s, rate)
        y0 -= rate * float(g.sum())
        inits.append(float(y0))
    return losses, inits
