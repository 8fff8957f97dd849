"""Event sampling, volatility targets, barriers, labels and trend scanning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grouped import fold_series
from ..functions.series import ordered
from .joins import asof


def cusum_events(prices: DataFrame, threshold: float | str) -> DataFrame:
    """symbol, event_start: where a sum of price moves, floored at zero on its side, passes the threshold.

    threshold: a number, or the name of a column with one per row.  The falling side is looked at first
    and only the side that fires starts anew.
    """
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))

    def step(state: dict, rows: pd.DataFrame) -> list:
        hits = []
        for ts, close, limit in zip(rows["ts"], rows["close"].astype(float), rows["limit_"].astype(float)):
            move = close - state.get("close", close)
            up, down = max(0.0, state.get("up", 0.0) + move), min(0.0, state.get("down", 0.0) + move)
            if "close" in state and down < -limit:
                down = 0.0
                hits.append((ts,))
            elif "close" in state and up > limit:
                up = 0.0
                hits.append((ts,))
            state.update(close=close, up=up, down=down)
        return hits

    return fold_series(prices.select("symbol", "ts", "close", limit.alias("limit_")), "symbol", ["ts"], dict, step, ["event_start"], "event_start timestamp_ntz")


def daily_volatility(prices: DataFrame, span: int = 100) -> DataFrame:
    """symbol, ts, volatility: debiased exponential deviation of log returns over the last row before ts - 1 day."""
    probes = prices.select("symbol", "ts", "close", (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("before"))
    earlier = asof(probes, prices.select("symbol", F.col("ts").alias("past_ts"), F.col("close").alias("past")), "symbol", "before", "past_ts", ["past"], inclusive=False)
    returns = earlier.filter(F.col("past").isNotNull()).select("symbol", "ts", F.ln(F.try_divide("close", "past")).alias("r"))

    keep = 1 - 2 / (span + 1)

    def step(state: dict, rows: pd.DataFrame) -> list:
        # weights' sum and squares' sum, mean and weighted squares about it, of all returns so far
        w, ww, mean, squares = state.get("now", (0.0, 0.0, 0.0, 0.0))
        out = []
        for ts, r in zip(rows["ts"], rows["r"].to_numpy(float)):
            w, ww, squares = w * keep, ww * keep * keep, squares * keep
            if r == r:
                off = r - mean
                squares += w / (w + 1) * off * off
                w, ww = w + 1, ww + 1
                mean += off / w
            left = w * w - ww
            out.append((ts, float(np.sqrt(squares / w * w * w / left)) if w and left > 1e-12 * w * w else None))
        state["now"] = (w, ww, mean, squares)
        return out

    return fold_series(returns, "symbol", ["ts"], dict, step, ["ts", "volatility"], "ts timestamp_ntz, volatility double")


def vertical_barriers(prices: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """symbol, event_start, barrier: the first price time at or after so many days; events beyond the end are dropped."""
    probes = events.select("symbol", "event_start", (F.col("event_start") + F.make_dt_interval(F.lit(days))).alias("due"))
    found = asof(probes, prices.select("symbol", F.col("ts")), "symbol", "due", "ts", [], direction="forward")
    return found.filter(F.col("asof_ts").isNotNull()).select("symbol", "event_start", F.col("asof_ts").alias("barrier"))


def triple_barrier(prices: DataFrame, events: DataFrame, profit: float, loss: float, bucket_seconds: int = 86400) -> DataFrame:
    """events (symbol, event_start, barrier, base_width, side) with end_time: the earliest barrier touched.

    A multiplier of 0 or less takes its horizontal barrier away.  Without a vertical barrier prices are
    looked at to the end, and end_time is null if nothing is touched.

    Events meet prices by (symbol, bucket of time), a copy of the event for each bucket up to its barrier or else to
    the symbol's last price, so a long price series is never crossed with all its events.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    start = prices.select("symbol", F.col("ts").alias("event_start"), F.col("close").alias("p0"))
    last = prices.groupBy("symbol").agg(F.max("ts").alias("_last"))
    begun = events.join(start, ["symbol", "event_start"]).join(last, "symbol").withColumn("_until", F.coalesce("barrier", "_last"))
    begun = begun.filter(F.col("_until") >= F.col("event_start")).withColumn("_b", F.explode(F.sequence(bucket("event_start"), bucket("_until"))))
    points = prices.select("symbol", "ts", "close").withColumn("_b", bucket("ts"))
    path = begun.join(points, ["symbol", "_b"]).filter((F.col("ts") >= F.col("event_start")) & (F.col("ts") <= F.col("_until")))
    move = F.ln(F.try_divide("close", "p0")) * F.col("side")
    won = F.min(F.when(move > profit * F.col("base_width"), F.col("ts"))) if profit > 0 else F.lit(None).cast("timestamp_ntz")
    lost = F.min(F.when(move < -loss * F.col("base_width"), F.col("ts"))) if loss > 0 else F.lit(None).cast("timestamp_ntz")
    touched = path.groupBy("symbol", "event_start").agg(won.alias("won"), lost.alias("lost"))
    return events.join(touched, ["symbol", "event_start"], "left").withColumn("end_time", F.least("barrier", "won", "lost")).drop("won", "lost")


def meta_events(prices: DataFrame, events: DataFrame, targets: DataFrame, profit_loss: tuple[float, float], least_return: float, barriers: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    """symbol, event_start, end_time, base_width (and side, if sides are given)."""
    kept = events.join(targets.select("symbol", F.col("ts").alias("event_start"), F.col("volatility").alias("base_width")), ["symbol", "event_start"])
    kept = kept.filter(F.col("base_width").isNotNull() & ~F.isnan("base_width") & (F.col("base_width") > least_return))
    kept = kept.join(barriers, ["symbol", "event_start"], "left") if barriers is not None else kept.withColumn("barrier", F.lit(None).cast("timestamp_ntz"))
    if sides is None:
        profit, loss = profit_loss[0], profit_loss[0]
        kept = kept.withColumn("side", F.lit(1.0))
    else:
        profit, loss = profit_loss
        kept = kept.join(sides, ["symbol", "event_start"], "left").withColumn("side", F.coalesce("side", F.lit(1.0)))
    out = triple_barrier(prices, kept, profit, loss)
    return out.select("symbol", "event_start", "end_time", "base_width", *(["side"] if sides is not None else []))


def meta_labels(prices: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, event_start, end_time, ret, label (and side): with a side, losing bets are 0."""
    at = lambda n, c: prices.select("symbol", F.col("ts").alias(c), F.col("close").alias(n))
    joined = events.filter(F.col("end_time").isNotNull()).join(at("p0", "event_start"), ["symbol", "event_start"]).join(at("p1", "end_time"), ["symbol", "end_time"])
    sided = "side" in events.columns
    ret = (F.ln("p1") - F.ln("p0")) * (F.col("side") if sided else F.lit(1.0))
    out = joined.withColumn("ret", ret).withColumn("label", F.signum("ret"))
    if sided:
        out = out.withColumn("label", F.when(F.col("ret") <= 0, 0.0).otherwise(F.col("label")))
    return out.select("symbol", "event_start", "end_time", "ret", "label", *(["side"] if sided else []))


def slope_t_value(y: str, x: str):
    """t value of a regression's slope as an aggregate; null for fewer than three rows or a perfect fit."""
    n = F.count(y)
    sse = F.greatest(F.expr(f"regr_syy({y}, {x})") - F.expr(f"regr_sxy({y}, {x})") * F.expr(f"regr_slope({y}, {x})"), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.try_divide(sse, n - 2), F.expr(f"regr_sxx({y}, {x})")))
    return F.when(n > 2, F.try_divide(F.expr(f"regr_slope({y}, {x})"), error))


def linear_t_value(y: np.ndarray) -> float:
    """The same for one series against 0, 1, 2...; infinite for a perfect slope."""
    n = len(y)
    if n < 2:
        return math.nan
    x = np.arange(n) - (n - 1) / 2
    slope = x @ y / (x @ x)
    rest = y - y.mean() - slope * x
    error = math.sqrt(max(0.0, rest @ rest) / (n - 2) / (x @ x)) if n > 2 else 0.0
    if error < 1e-14:
        return math.copysign(math.inf, slope) if slope else math.nan
    return float(slope / error)


def trend_scanning(prices: DataFrame, starts: DataFrame, spans: tuple[int, int]) -> DataFrame:
    """symbol, event_start, end_time, t_value, trend: the span with the greatest |t| of those in [a, b).

    Ties keep the shorter span.  end_time is that of the longest span for every event; events without
    so many prices ahead are dropped.
    """
    a, b = spans
    w = ordered("symbol", "ts")
    placed = prices.select("symbol", "ts", "close", F.row_number().over(w).alias("pos"))
    e = starts.join(placed.select("symbol", F.col("ts").alias("event_start"), F.col("pos").alias("p0")), ["symbol", "event_start"])
    e = e.select("symbol", "event_start", "p0", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("k")).withColumn("pos", F.col("p0") + F.col("k"))
    path = e.join(placed, ["symbol", "pos"]).select("symbol", "event_start", "k", "ts", F.col("close").alias("y"))
    ends = path.groupBy("symbol", "event_start").agg(F.max(F.when(F.col("k") == b - 1, F.col("ts"))).alias("end_time")).filter(F.col("end_time").isNotNull())
    spread = path.withColumn("span", F.explode(F.sequence(F.lit(a), F.lit(b - 1)))).filter(F.col("k") < F.col("span")).withColumn("x", F.col("k").cast("double"))
    fits = spread.groupBy("symbol", "event_start", "span").agg(F.coalesce(slope_t_value("y", "x"), F.lit(0.0)).alias("t"))
    best = fits.groupBy("symbol", "event_start").agg(F.max_by("t", F.struct(F.abs("t"), -F.col("span"))).alias("t_value"))
    return ends.join(best, ["symbol", "event_start"]).withColumn("trend", F.signum("t_value"))


def concurrency(prices: DataFrame, events: DataFrame, molecule: DataFrame | None = None) -> DataFrame:
    """symbol, ts, concurrency: events open at each price from the first event's start to the last end.

    With a molecule (symbol, event_start) only its events' span is covered, by the events that end after
    its first start.
    """
    if molecule is not None:
        first = molecule.groupBy("symbol").agg(F.min("event_start").alias("first"))
        inside = events.join(molecule, ["symbol", "event_start"], "left_semi")
        events = inside.join(first, "symbol").filter(F.col("end_time") > F.col("first")).drop("first")
    span = events.groupBy("symbol").agg(F.min("event_start").alias("lo"), F.max("end_time").alias("hi"))
    bars = prices.select("symbol", "ts").join(span, "symbol").filter(F.col("ts").between(F.col("lo"), F.col("hi"))).select("symbol", "ts")
    # +1 at a start, -1 just after an end, in one sorted sweep with the prices
    steps = events.select("symbol", F.col("event_start").alias("ts"), F.lit(0).alias("o"), F.lit(1).alias("d")).unionByName(events.select("symbol", F.col("end_time").alias("ts"), F.lit(2).alias("o"), F.lit(-1).alias("d"))).unionByName(bars.select("symbol", "ts", F.lit(1).alias("o"), F.lit(0).alias("d")))
    w = Window.partitionBy("symbol").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("concurrency", F.sum("d").over(w).cast("double")).filter(F.col("o") == 1).select("symbol", "ts", "concurrency")


def _prefix(prices: DataFrame, counts: DataFrame, value) -> DataFrame:
    """symbol, ts, total: running sum of value over prices with their concurrency (1 where there is none)."""
    w = ordered("symbol", "ts")
    joined = prices.join(counts, ["symbol", "ts"], "left").withColumn("c", F.greatest(F.coalesce("concurrency", F.lit(0.0)), F.lit(1.0))).withColumn("_r", F.ln("close") - F.lag(F.ln("close")).over(w))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(value(F.col("c"), F.col("_r")), F.lit(0.0))
    return joined.withColumn("_v", v).select("symbol", "ts", F.sum("_v").over(running).alias("total"), (F.sum("_v").over(running) - F.col("_v")).alias("before"), F.row_number().over(w).alias("pos"))


def _over_spans(sums: DataFrame, events: DataFrame) -> DataFrame:
    """events with total: sums between start and end inclusive, as a difference of running sums."""
    lo = sums.select("symbol", F.col("ts").alias("event_start"), F.col("before").alias("_lo"), F.col("pos").alias("_p"))
    hi = sums.select("symbol", F.col("ts").alias("end_time"), F.col("total").alias("_hi"), F.col("pos").alias("_q"))
    return events.join(lo, ["symbol", "event_start"]).join(hi, ["symbol", "end_time"]).select("symbol", "event_start", "end_time", (F.col("_hi") - F.col("_lo")).alias("total"), (F.col("_q") - F.col("_p") + 1).alias("length"))


def average_uniqueness(prices: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, event_start, end_time, uniqueness: mean of 1 / concurrency over the event's prices."""
    spans = _over_spans(_prefix(prices, concurrency(prices, events), lambda c, r: 1.0 / c), events)
    return spans.select("symbol", "event_start", "end_time", (F.col("total") / F.col("length")).alias("uniqueness"))


def absolute_return_weights(prices: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, event_start, end_time, weight: |sum of log return / concurrency|, scaled to sum to the number of events."""
    spans = _over_spans(_prefix(prices, concurrency(prices, events), lambda c, r: F.abs(r) / c), events)
    raw = spans.withColumn("raw", F.abs("total"))
    w = Window.partitionBy("symbol")
    total = F.sum("raw").over(w)
    return raw.withColumn("weight", F.when(total == 0, F.lit(1.0)).otherwise(F.col("raw") * F.count(F.lit(1)).over(w) / F.nullif(total, F.lit(0.0)))).select("symbol", "event_start", "end_time", "weight")


def time_decay(weights: DataFrame, last: float, order: str = "event_start") -> DataFrame:
    """weights with decay: linear in the running weight, from `last` for the oldest up to 1."""
    if not 0 <= last <= 1:
        raise ValueError("last is from 0 to 1")
    w = ordered("symbol", order)
    share = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(Window.partitionBy("symbol"))
    return weights.withColumn("decay", last + (1 - last) * share)
