"""As-of, interval and purge joins as unions, windows and bucketed equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, values: list[str], direction: str = "backward", inclusive: bool = True) -> DataFrame:
    """left with the values of right's last row at or before `at` (backward) or first at or after (forward).

    Both sides are put in one order per key and swept by one window: a sort and no nested loop.
    Left rows without a match get nulls.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    back = direction == "backward"
    probe_last = back == inclusive
    found = F.struct(F.col(ts).alias(ts), *values)
    r = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0 if probe_last else 1).alias("_o"), found.alias("_v"), F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, t in left.dtypes) + ">").alias("_l"))
    l = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1 if probe_last else 0).alias("_o"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    w = Window.partitionBy("_k").orderBy("_t", "_o")
    value = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    swept = l.unionByName(r).withColumn("_f", value).filter(F.col("_l").isNotNull())
    out = {c: f"_l.{c}" for c in left.columns}
    return swept.select(*[F.col(p).alias(c) for c, p in out.items()], F.col(f"_f.{ts}").alias(f"asof_{ts}"), *[F.col(f"_f.{v}").alias(v) for v in values])


def interval_join(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, bucket: int) -> DataFrame:
    """Points within [start, end] of spans; positions are integers, dealt to buckets of `bucket` of them.

    A span is copied to each bucket it touches, so the join is an equi join on (key, bucket).
    """
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    return s.join(p, [key, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def delta_sweep(signals: DataFrame, key: str, start: str, end: str, value: str) -> DataFrame:
    """key, at, n, total: the open [start, end) signals and their sum at each time where that may change."""
    opened = signals.select(key, F.col(start).alias("at"), F.lit(1).alias("n"), F.col(value).alias("v"))
    closed = signals.filter(F.col(end).isNotNull()).select(key, F.col(end).alias("at"), F.lit(-1).alias("n"), (-F.col(value)).alias("v"))
    steps = opened.unionByName(closed).groupBy(key, "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, "at", F.sum("n").over(w).alias("n"), F.sum("v").over(w).alias("total"))
