"""Bars over a stream of ticks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.bars import FOLD_COLUMNS, SECONDS, Fold, Rule
from ..runtime import ship
from ..schemas import BARS_DDL


class _BarProcessor(StatefulProcessor):
    """Keeps each symbol's fold as a value state; ticks of a micro-batch are ordered by (ts, seq).

    A tick that is older by (ts, seq) than the last one taken is late: the fold has passed it, so it is left
    out.  A symbol's state is one fold, whose lists are bounded by the rule's windows.
    """

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.state = handle.getValueState("fold", "fold string, at long, seq long")

    def handleInputRows(self, key, rows, timerValues):
        fold, last = Fold(), (-(1 << 62), -(1 << 62))
        if self.state.exists():
            stored, *last = self.state.get()
            last = tuple(last)
            fold = Fold(**json.loads(stored))
        ticks = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        bars = []
        for ts, seq, price, volume in zip(ticks["ts"], ticks["seq"], ticks["price"], ticks["volume"]):
            at = (int(pd.Timestamp(ts).value), int(seq))
            if at <= last:
                continue
            last = at
            if bar := fold.add(self.rule, ts, float(price), float(volume)):  # missing ones are nan here
                bars.append((key[0], *bar))
        self.state.update((json.dumps(vars(fold)), *last))
        yield pd.DataFrame(bars, columns=["symbol", *FOLD_COLUMNS])

    def close(self) -> None:
        pass


def stream_bars(ticks: DataFrame, rule: Rule) -> DataFrame:
    """Closed bars of a streaming DataFrame of ticks; needs the RocksDB state store."""
    ship(ticks.sparkSession)
    return ticks.groupBy("symbol").transformWithStateInPandas(_BarProcessor(rule), f"symbol string, {BARS_DDL}", "Append", "None")


class _BucketProcessor(StatefulProcessor):
    """Open buckets of each symbol, closed by event time: a bucket goes when its end and `delay` have passed.

    A symbol's clock is the latest time that its earlier micro-batches have shown.  A tick whose bucket has
    gone by then is late: it is left out of the bars and counted aside.  So a symbol's state is its clock and the
    buckets of the last `delay`, however long the stream is.
    """

    def __init__(self, size: int, delay: int):
        self.size, self.delay = size * 1_000_000, delay * 1_000_000

    def init(self, handle) -> None:
        self.state = handle.getValueState("buckets", "buckets string, clock long")

    def handleInputRows(self, key, rows, timerValues):
        buckets, clock = {}, None
        if self.state.exists():
            stored, clock = self.state.get()
            buckets = {int(k): v for k, v in json.loads(stored).items()}
        ticks = pd.concat(list(rows))
        at = (ticks["ts"].astype("datetime64[us]").astype("int64")).to_numpy()
        ticks = ticks.assign(at=at, bucket=at // self.size).sort_values(["at", "seq"], kind="stable")
        out = []
        late = pd.Series(False, index=ticks.index)
        if clock is not None:
            late = (ticks["bucket"] + 1) * self.size + self.delay <= clock
        for bucket, n in ticks[late]["bucket"].value_counts().items():
            out.append((key[0], int(bucket), *[None] * 6, int(n)))
        for bucket, part in ticks[~late].groupby("bucket"):
            buckets[int(bucket)] = _merged(buckets.get(int(bucket)), part)
        clock = max(int(at.max()), clock if clock is not None else int(at.max()))
        for bucket in sorted(b for b in buckets if (b + 1) * self.size + self.delay <= clock):
            b = buckets.pop(bucket)
            out.append((key[0], bucket, b["open"][2], b["high"], b["low"], b["close"][2], b["volume"], b["ticks"], 0))
        self.state.update((json.dumps(buckets), clock))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "open", "high", "low", "close", "cumulative_volume", "cumulative_ticks", "late_ticks"]).astype({"cumulative_ticks": "Int64", "late_ticks": "Int64", "bar_id": "Int64"})

    def close(self) -> None:
        pass


def _merged(b: dict | None, part: pd.DataFrame) -> dict:
    """A bucket with more ticks, in order of time and number; missing prices are passed over, volumes count as 0."""
    b = b or {"open": [None, None, None], "close": [None, None, None], "high": None, "low": None, "volume": 0.0, "ticks": 0}
    priced = part[part["price"].notna()]
    if len(priced):
        first, last = ([int(r["at"]), int(r["seq"]), float(r["price"])] for r in (priced.iloc[0], priced.iloc[-1]))
        b["open"] = first if b["open"][0] is None else min(b["open"], first)
        b["close"] = last if b["close"][0] is None else max(b["close"], last)
        b["high"] = max(float(priced["price"].max()), b["high"] if b["high"] is not None else float("-inf"))
        b["low"] = min(float(priced["price"].min()), b["low"] if b["low"] is not None else float("inf"))
    b["volume"] += float(part["volume"].fillna(0.0).sum())
    b["ticks"] += len(part)
    return b


BUCKETS_DDL = "symbol string, bar_id long, open double, high double, low double, close double, cumulative_volume double, cumulative_ticks long, late_ticks long"


def stream_buckets(ticks: DataFrame, resolution: str, units: int = 1, delay: int = 0) -> DataFrame:
    """Time bars of a streaming DataFrame of ticks and, beside them, rows that count late ticks.

    A bar's row has late_ticks 0; a row of late ticks has their bucket and number, and null else.  `delay` is in
    seconds.  A symbol's buckets within `delay` of its latest tick stay open.  Ticks without a symbol are left
    out.  Needs the RocksDB state store.
    """
    ship(ticks.sparkSession)
    size = SECONDS[resolution.upper()] * units
    return ticks.filter(F.col("symbol").isNotNull()).groupBy("symbol").transformWithStateInPandas(_BucketProcessor(size, delay), BUCKETS_DDL, "Append", "None")


def time_bars_of(buckets: DataFrame, resolution: str, units: int = 1) -> DataFrame:
    """The bars among the rows of stream_buckets, with the end of their bucket."""
    size = SECONDS[resolution.upper()] * units
    return buckets.filter("late_ticks = 0").drop("late_ticks").withColumn("date_time", F.timestamp_seconds((F.col("bar_id") + 1) * size).cast("timestamp_ntz"))


def late_ticks_of(buckets: DataFrame) -> DataFrame:
    """symbol, bar_id, late_ticks: how many ticks came after their bucket had gone."""
    return buckets.filter("late_ticks > 0").groupBy("symbol", "bar_id").agg(F.sum("late_ticks").alias("late_ticks"))


def stream_time_bars(ticks: DataFrame, resolution: str, units: int = 1, late: str = "10 seconds") -> DataFrame:
    """Time bars closed by Spark's own watermark over all symbols, which drops ticks later than `late` uncounted."""
    size = SECONDS[resolution.upper()] * units
    w = F.window("ts", f"{size} seconds")
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "seq")
    return timed.groupBy("symbol", w).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("cumulative_volume"), F.count(F.lit(1)).alias("cumulative_ticks")).withColumn("date_time", F.col("window.end").cast("timestamp_ntz")).drop("window")
