"""Bars sampled from ticks.

Tick and time bars have a closed form: bar numbers by window, then one aggregation.  Volume, dollar,
imbalance and run bars reset their sums when a bar closes, so each symbol is folded in order; one fold
serves batch (over sorted batches of rows) and streaming (state per symbol).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grouped import fold_series
from ..functions.series import forward_fill, ordered
from ..schemas import BARS, BARS_DDL

METRICS = ("tick", "volume", "dollar")
SECONDS = {"S": 1, "MIN": 60, "H": 3600, "D": 86400, "W": 604800}


def tick_rule(ticks: DataFrame) -> DataFrame:
    """ticks with sign: of the last price change that wasn't zero; 0 before any.

    A price that is null or no number is missing: its tick has the sign before it, and the next price is
    compared with the last one known.
    """
    w = ordered("symbol", "ts", "seq")
    ticks = ticks.withColumn("price", known(F.col("price")))
    before = F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.nullif(F.signum(F.col("price") - before), F.lit(0.0))
    return ticks.withColumn("_step", step).withColumn("sign", F.coalesce(forward_fill(F.col("_step"), w), F.lit(0.0))).drop("_step")


def known(x: Column) -> Column:
    """Null for what is no number."""
    return F.when(~F.isnan(x), x)


def metric_column(metric: str) -> Column:
    return {"tick": F.lit(1.0), "volume": F.col("volume"), "dollar": F.col("price") * F.col("volume")}[metric]


def signed_metric(metric: str) -> Column:
    return F.col("sign") * metric_column(metric)


def _aggregate(numbered: DataFrame, stamp: Column, threshold: Column) -> DataFrame:
    """One row per (symbol, bar_id): opening to closing price, sums, last tick's index.

    Missing prices are passed over (a bar without any has null prices), missing volumes count as 0.
    """
    volume = F.coalesce(known(F.col("volume")), F.lit(0.0))
    buy = F.sum(F.when(F.col("sign") == 1.0, volume).otherwise(0.0))
    priced = F.when(F.col("price").isNotNull(), F.col("tick_index"))
    return numbered.groupBy("symbol", "bar_id").agg(
        stamp.alias("date_time"), F.max("tick_index").alias("tick_index"), F.min_by("price", priced).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", priced).alias("close"),
        F.sum(volume).alias("cumulative_volume"), buy.alias("cumulative_buy_volume"), (F.sum(volume) - buy).alias("cumulative_sell_volume"), F.count(F.lit(1)).cast("double").alias("cumulative_ticks"), F.sum(F.coalesce(F.col("price") * volume, F.lit(0.0))).alias("cumulative_dollar_value"), threshold.alias("threshold"),
    ).select(*BARS)


def tick_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """A bar per `threshold` ticks; an incomplete last bar is dropped."""
    n = math.ceil(threshold)
    indexed = tick_rule(ticks).withColumn("tick_index", F.row_number().over(ordered("symbol", "ts", "seq")).cast("long"))
    numbered = indexed.withColumn("bar_id", F.floor((F.col("tick_index") - 1) / n))
    return _aggregate(numbered, F.max("ts"), F.lit(float(threshold))).filter(F.col("cumulative_ticks") == n)


def time_bars(ticks: DataFrame, resolution: str, units: int = 1) -> DataFrame:
    """Epoch-aligned buckets stamped with their end; a symbol's last bucket is open and not returned."""
    if resolution.upper() not in SECONDS:
        raise ValueError(f"resolution is one of {', '.join(SECONDS)}")
    size = SECONDS[resolution.upper()] * units
    indexed = tick_rule(ticks).withColumn("tick_index", F.row_number().over(ordered("symbol", "ts", "seq")).cast("long"))
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(size * 1_000_000)).cast("long")
    numbered = indexed.withColumn("bar_id", bucket)
    end = (F.col("bar_id") + 1) * size
    bars = _aggregate(numbered, F.max(F.timestamp_seconds(end).cast("timestamp_ntz")), F.max(end.cast("double")))
    return bars.withColumn("_last", F.max("bar_id").over(Window.partitionBy("symbol"))).filter(F.col("bar_id") < F.col("_last")).drop("_last")


@lru_cache(maxsize=256)
def _powers(window: int, n: int) -> tuple[tuple[float, ...], float]:
    """Weights of n values, oldest first, and their sum."""
    keep = 1 - 2 / (window + 1)
    weights = tuple(keep ** (n - 1 - k) for k in range(n))
    total = 0.0
    for w in weights:
        total += w
    return weights, total


def last_ewma(values: list[float], window: int) -> float:
    """Last value of the adjusted exponential mean with smoothing 2 / (window + 1).

    Powers of the smoothing, added one after another as SQL adds them: bars close where a whole number reaches a
    product of such means, so their last digits matter.
    """
    weights, total = _powers(window, len(values))
    num = 0.0
    for v, w in zip(values, weights):
        num += v * w
    return num / total if total else math.nan


@dataclass
class Rule:
    """When a bar closes, and what is expected of the next one.

    kind: standard, imbalance or run; metric: tick, volume or dollar.  expected_ticks is E[T] at first;
    with ticks_window it follows the closed bars' lengths within bounds, else it stays.
    """

    kind: str
    metric: str = "tick"
    threshold: float = 0.0
    expected_ticks: float = math.nan
    imbalance_window: int = 1
    ticks_window: int | None = None
    bounds: tuple[float, float] = (0.0, math.inf)

    def __post_init__(self):
        if self.kind not in ("standard", "imbalance", "run") or self.metric not in METRICS:
            raise ValueError("kind is standard, imbalance or run; metric tick, volume or dollar")


@dataclass
class Fold:
    """State of one symbol between ticks: plain values, so that it can be stored."""

    tick_index: int = 0
    bar_id: int = 0
    sign: float = 0.0
    last_price: float | None = None
    open: float | None = None
    high: float | None = None
    low: float | None = None
    close: float | None = None
    ticks: int = 0
    buys: int = 0
    volume: float = 0.0
    buy_volume: float = 0.0
    dollars: float = 0.0
    theta: list = field(default_factory=lambda: [0.0, 0.0])  # buy and sell sums, or one signed sum
    seen: list = field(default_factory=lambda: [[], []])  # the last imbalances, by side for runs
    counts: list = field(default_factory=lambda: [0, 0])  # how many imbalances there were
    expected: list = field(default_factory=lambda: [math.nan, math.nan])
    buy_share: float = math.nan
    expected_ticks: float | None = None
    lengths: list = field(default_factory=list)
    shares: list = field(default_factory=list)

    def _remember(self, side: int, value: float, window: int) -> None:
        self.counts[side] += 1
        self.seen[side].append(value)
        del self.seen[side][:-window]

    def _estimate(self, rule: Rule, side: int, warm_up: bool) -> float:
        if warm_up and not self.counts[side] >= self.expected_ticks:
            return math.nan
        return last_ewma(self.seen[side], len(self.seen[side]))

    def _limit(self, rule: Rule, imbalance: float) -> tuple[float, bool]:
        """The threshold after this tick, and whether the bar closes."""
        if rule.kind == "standard":
            reached = {"tick": self.ticks, "volume": self.volume, "dollar": self.dollars}[rule.metric]
            return rule.threshold, reached >= rule.threshold
        if rule.kind == "imbalance":
            self._remember(0, imbalance, rule.imbalance_window)
            self.theta[0] += imbalance
            if math.isnan(self.expected[0]):
                self.expected[0] = self._estimate(rule, 0, True)
            limit = self.expected_ticks * abs(self.expected[0])
            return limit, math.isfinite(limit) and abs(self.theta[0]) >= limit
        if imbalance:
            side = int(imbalance < 0)
            self._remember(side, abs(imbalance), rule.imbalance_window)
            self.theta[side] += abs(imbalance)
            self.buys += imbalance > 0
        if any(map(math.isnan, (*self.expected, self.buy_share))):
            self.expected = [self._estimate(rule, s, True) for s in (0, 1)]
            self.buy_share = self.buys / self.ticks
        limit = self.expected_ticks * max(self.buy_share * self.expected[0], (1 - self.buy_share) * self.expected[1])
        unknown = any(map(math.isnan, (self.expected_ticks, *self.expected, self.buy_share)))
        return limit, not unknown and math.isfinite(limit) and max(self.theta) >= limit

    def _close(self, rule: Rule) -> None:
        if rule.kind != "standard":
            if rule.ticks_window:
                self.lengths = [*self.lengths, self.ticks][-rule.ticks_window :]
                self.expected_ticks = min(max(last_ewma(self.lengths, rule.ticks_window), rule.bounds[0]), rule.bounds[1])
            if rule.kind == "run":
                window = rule.ticks_window or rule.imbalance_window
                self.shares = [*self.shares, self.buys / self.ticks][-window:]
                self.buy_share = last_ewma(self.shares, window)
                self.expected = [self._estimate(rule, s, False) for s in (0, 1)]
            else:
                self.expected[0] = self._estimate(rule, 0, False)
        self.bar_id += 1
        self.open = self.high = self.low = self.close = None
        self.ticks = self.buys = 0
        self.volume = self.buy_volume = self.dollars = 0.0
        self.theta = [0.0, 0.0]

    def add(self, rule: Rule, ts, price: float | None, volume: float | None) -> tuple | None:
        """Take one tick; the closed bar, if it closes one.

        A missing price (None or no number) is passed over: the tick has the sign before it and no value; a missing
        volume counts as 0.
        """
        if self.expected_ticks is None:
            self.expected_ticks = rule.expected_ticks
        self.tick_index += 1
        self.ticks += 1
        volume = 0.0 if volume is None or volume != volume else volume
        dollars = 0.0
        if price is not None and price == price:
            if self.last_price is not None and price != self.last_price:
                self.sign = 1.0 if price > self.last_price else -1.0
            self.last_price = self.close = price
            if self.open is None:
                self.open = self.high = self.low = price
            self.high, self.low = max(self.high, price), min(self.low, price)
            dollars = price * volume
        self.volume += volume
        self.dollars += dollars
        self.buy_volume += volume if self.sign == 1.0 else 0.0
        unit = {"tick": 1.0, "volume": volume, "dollar": dollars}[rule.metric]
        limit, closes = self._limit(rule, self.sign * unit)
        if not closes:
            return None
        bar = (self.bar_id, ts, self.tick_index, self.open, self.high, self.low, self.close, self.volume, self.buy_volume, self.volume - self.buy_volume, float(self.ticks), self.dollars, limit)
        self._close(rule)
        return bar


FOLD_COLUMNS = list(BARS[1:])


def fold_bars(ticks: DataFrame, rule: Rule) -> DataFrame:
    """Bars of a rule, folded over each symbol's ticks in order of ts and seq; ticks without a symbol are left out."""

    def step(state: Fold, rows: pd.DataFrame) -> list:
        return [b for t, p, v in zip(rows["ts"], rows["price"].astype(float), rows["volume"].astype(float)) if (b := state.add(rule, t, p, v))]

    return fold_series(ticks.select("symbol", "ts", "seq", "price", "volume"), "symbol", ["ts", "seq"], Fold, step, FOLD_COLUMNS, BARS_DDL)


def standard_bars(ticks: DataFrame, metric: str, threshold: float) -> DataFrame:
    return tick_bars(ticks, threshold) if metric == "tick" else fold_bars(ticks, Rule("standard", metric, threshold))


def imbalance_bars(ticks: DataFrame, metric: str, expected_ticks: float, window: int, ticks_window: int | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Fixed expected length without ticks_window, else expected from closed bars."""
    return fold_bars(ticks, Rule("imbalance", metric, 0.0, expected_ticks, window, ticks_window, bounds or (0.0, math.inf)))


def run_bars(ticks: DataFrame, metric: str, expected_ticks: float, window: int, ticks_window: int | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    return fold_bars(ticks, Rule("run", metric, 0.0, expected_ticks, window, ticks_window, bounds or (0.0, math.inf)))


def build_bars(kind: str, ticks: DataFrame, **parameters) -> DataFrame:
    """Bars by name: <metric>_standard, <metric>_imbalance_fixed or _expected, <metric>_run_fixed or _expected, time."""
    if kind == "time":
        return time_bars(ticks, **parameters)
    metric, family, *mode = kind.split("_")
    if metric not in METRICS or family not in ("standard", "imbalance", "run") or (mode or ["fixed"])[0] not in ("fixed", "expected"):
        raise ValueError(f"no bars named {kind}")
    if family == "standard":
        return standard_bars(ticks, metric, **parameters)
    if mode == ["fixed"]:
        parameters.pop("ticks_window", None)
    return (imbalance_bars if family == "imbalance" else run_bars)(ticks, metric, **parameters)
