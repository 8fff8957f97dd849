"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can.

Doubles are rounded on both sides, as sums of doubles depend on their order in the last digits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normal import phi, phi_inv, phi_inv_sql, phi_sql
from ..functions.series import ordered
from ..functions.special import DF_LARGE, DF_MAX, DF_MIN, DF_SMALL, DF_STAR, EULER, norm_ppf
from ..operators import backtest as B
from ..operators import bars, breaks, dependence, entropy, fracdiff, importance, labels, matrix, microstructure, neighbours, ou, pde, synthetic
from ..operators import validation as V
from ..operators.joins import asof, interval_join
from ..runtime import scratch_path, table
from ..schemas import BARS_DDL
from ..sources import ticks as S
from ..streaming import bars as streamed
from ..streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits, without minus zero; other columns as they are."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register fn(spark, sf_dir); sql's columns named in doubles are rounded like the query's."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql:
            parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            ORACLES[name] = f"{sql_ctes(sql)} SELECT * {f'REPLACE ({parts})' if parts else ''} FROM result"
        return fn

    return register


CTES = {
    "ticks": "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, regexp_extract(props, '([0-9]+)', 1)::DOUBLE + 1 AS volume FROM events",
    "signed": """SELECT *, coalesce(last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::DOUBLE AS sign
        FROM (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq))::DOUBLE AS step, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS tick_index FROM ticks)""",
    "daily": "SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value), 6) AS pnl, max_by(value, event_id) AS close FROM events GROUP BY 1, 2",
    "hourly": """SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close FROM events GROUP BY 1, 2""",
    "returns": "SELECT symbol, ts, x FROM (SELECT symbol, ts, ln(CASE WHEN close > 0 THEN close END / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS x FROM daily) WHERE x IS NOT NULL",
    "perf": "SELECT datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS t, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS strategy, round(avg(value) - 49.0, 6) AS x FROM events GROUP BY 1, 2",
    "msgs": "SELECT doc_id AS id, substr(lower(coalesce(text, '')), 1) AS message FROM documents",
    "pos": "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, ts, close FROM daily",
    "info": "SELECT symbol, pos, pos AS start, pos + 2 AS \"end\" FROM pos",
    "evt": "SELECT p.symbol, p.ts AS event_start, p.pos AS p0, q.ts AS end_time, q.pos AS p1 FROM pos p JOIN pos q ON p.symbol = q.symbol AND q.pos = p.pos + 3",
}
NEEDS = {"signed": ["ticks"], "returns": ["daily"], "pos": ["daily"], "info": ["pos"], "evt": ["pos"]}


def sql_ctes(sql: str) -> str:
    """WITH clause of the named sub-queries that sql mentions as {name}, and sql itself as result."""
    used: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in used:
            used.append(n)

    for n in CTES:
        if "{" + n + "}" in sql:
            add(n)
        sql = sql.replace("{" + n + "}", n)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.replace("RECURSIVE ", "", 1) if recursive else sql
    own = ""
    if sql.lstrip().startswith("WITH "):
        head, _, tail = sql.lstrip()[5:].rpartition("---")
        own, sql = head.strip().rstrip(",") + ", ", tail
    return f"WITH {recursive}" + "".join(f"{n} AS ({CTES[n]}), " for n in used) + own + f"result AS ({sql})"


def events_ticks(spark, d):
    return S.ticks_from_events(spark, d)


def daily(spark, d):
    return S.daily_close(spark, d)


def hourly(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"))


def returns(spark, d):
    w = ordered("symbol", "ts")
    return daily(spark, d).withColumn("x", F.ln(F.try_divide(F.col("close"), F.lag("close").over(w)))).filter(F.col("x").isNotNull()).select("symbol", "ts", "x")


def positions(spark, d):
    return daily(spark, d).withColumn("pos", F.row_number().over(ordered("symbol", "ts"))).select("symbol", "pos", "ts", "close")


def info(spark, d):
    return positions(spark, d).select("symbol", "pos", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"))


def span_events(spark, d):
    """A span of three days from every day of a symbol."""
    p = positions(spark, d)
    later = p.select("symbol", (F.col("pos") - 3).alias("pos"), F.col("ts").alias("end_time"))
    return p.join(later, ["symbol", "pos"]).select("symbol", F.col("ts").alias("event_start"), "end_time")


def messages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("message"))


# ---- bars ------------------------------------------------------------------------------------------

_BAR = "symbol, bar_id::BIGINT AS bar_id, {stamp} AS date_time, max(tick_index) AS tick_index, min_by(price, tick_index) AS open, max(price) AS high, min(price) AS low, max_by(price, tick_index) AS close, sum(volume) AS cumulative_volume, sum(CASE WHEN sign = 1 THEN volume ELSE 0 END) AS cumulative_buy_volume, sum(volume) - sum(CASE WHEN sign = 1 THEN volume ELSE 0 END) AS cumulative_sell_volume, count(*)::DOUBLE AS cumulative_ticks, sum(price * volume) AS cumulative_dollar_value, {limit} AS threshold"
_BAR_DOUBLES = "cumulative_volume cumulative_buy_volume cumulative_sell_volume cumulative_dollar_value"


@query("tick_rule", "SELECT symbol, seq, sign FROM {signed}")
def _(spark, d):
    return bars.tick_rule(events_ticks(spark, d)).select("symbol", "seq", "sign")


@query("tick_bars", "SELECT " + _BAR.format(stamp="max(ts)", limit="20e0") + " FROM (SELECT *, (tick_index - 1) // 20 AS bar_id FROM {signed}) GROUP BY symbol, bar_id HAVING count(*) = 20", _BAR_DOUBLES)
def _(spark, d):
    return bars.tick_bars(events_ticks(spark, d), 20)


_SECONDS = "floor(epoch_us(ts) / 3600000000)::BIGINT"


@query("time_bars_hour", "SELECT * EXCLUDE (last) FROM (SELECT *, max(bar_id) OVER (PARTITION BY symbol) AS last FROM (SELECT " + _BAR.format(stamp="max(make_timestamp((bar_id + 1) * 3600000000))", limit="max((bar_id + 1) * 3600e0)") + " FROM (SELECT *, " + _SECONDS + " AS bar_id FROM {signed}) GROUP BY symbol, bar_id)) WHERE bar_id < last", _BAR_DOUBLES)
def _(spark, d):
    return bars.time_bars(events_ticks(spark, d), "H", 1)


def _fold_sql(metric: str, limit: float) -> str:
    return f"""WITH RECURSIVE t AS (SELECT *, {metric} AS m FROM {{signed}}), f AS (
      SELECT symbol, tick_index, 0::BIGINT AS bar_id, m AS c, m >= {limit} AS closed FROM t WHERE tick_index = 1
      UNION ALL SELECT t.symbol, t.tick_index, f.bar_id + f.closed::BIGINT, CASE WHEN f.closed THEN t.m ELSE f.c + t.m END, CASE WHEN f.closed THEN t.m ELSE f.c + t.m END >= {limit}
      FROM f JOIN t ON t.symbol = f.symbol AND t.tick_index = f.tick_index + 1)
      --- SELECT {_BAR.format(stamp='max(ts)', limit=f'{limit}::DOUBLE')} FROM (SELECT t.*, f.bar_id, bool_or(f.closed) OVER (PARTITION BY t.symbol, f.bar_id) AS is_full FROM t JOIN f USING (symbol, tick_index)) WHERE is_full GROUP BY symbol, bar_id"""


@query("volume_bars", _fold_sql("volume", 2000), _BAR_DOUBLES)
def _(spark, d):
    return bars.standard_bars(events_ticks(spark, d), "volume", 2000.0)


@query("dollar_bars", _fold_sql("price * volume", 100000), _BAR_DOUBLES)
def _(spark, d):
    return bars.standard_bars(events_ticks(spark, d), "dollar", 100000.0)


# ---- streams and files -----------------------------------------------------------------------------

#: Slices in which events arrive: by these times, and ticks whose number is a multiple of LAGGARDS one slice later.
_ARRIVALS, LAGGARDS, DELAY = ["2024-01-11", "2024-01-21"], 97, 600


def _feed(ticks: DataFrame, laggards: bool = False, **form) -> feeds.Feed:
    own = feeds.slices_by_time("ts", _ARRIVALS)
    if laggards:
        own = own + F.when(F.col("seq") % LAGGARDS == 0, 1).otherwise(0)
    return feeds.Feed(ticks.withColumn("slice", own), "slice", **form)


@query("volume_bars_streamed", _fold_sql("volume", 2000), _BAR_DOUBLES)
def _(spark, d):
    rule = bars.Rule("standard", "volume", 2000.0)
    return feeds.run_feed(_feed(events_ticks(spark, d)), len(_ARRIVALS) + 1, lambda s: streamed.stream_bars(s, rule), f"symbol string, {BARS_DDL}")


@query("csv_bars_streamed", _fold_sql("price * volume", 100000), _BAR_DOUBLES)
def _(spark, d):
    rule, out, checkpoint = bars.Rule("standard", "dollar", 100000.0), scratch_path(spark, "bars-csv"), scratch_path(spark, "checkpoint")
    feed = _feed(events_ticks(spark, d), form="csv", header=True, timestampNTZFormat=S.CSV_TIME)
    for k in range(len(_ARRIVALS) + 1):
        if feed.arrive(k):
            feeds.advance(streamed.stream_bars(feed.stream(), rule), checkpoint, batch=lambda df, number: S.append_csv(df, out, number))
    return S.appended_csv(spark, out, f"symbol string, {BARS_DDL}")


def _buckets(spark, d):
    plan = lambda s: streamed.stream_buckets(s, "H", 1, DELAY)
    return feeds.run_feed(_feed(events_ticks(spark, d), laggards=True), len(_ARRIVALS) + 2, plan, streamed.BUCKETS_DDL)


_ARRIVED = f"""WITH t AS (SELECT *, {" + ".join(f"(ts >= TIMESTAMP '{b}')::INTEGER" for b in _ARRIVALS)} + (seq % {LAGGARDS} = 0)::INTEGER AS slice, floor(epoch_us(ts) / 3600000000)::BIGINT AS bar_id FROM {{ticks}}),
  c AS (SELECT symbol, slice, max(max(ts)) OVER (PARTITION BY symbol ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock, max(max(ts)) OVER (PARTITION BY symbol) AS latest FROM t GROUP BY symbol, slice),
  a AS (SELECT t.*, coalesce((bar_id + 1) * 3600000000 + {DELAY}000000 <= epoch_us(clock), FALSE) AS late, (bar_id + 1) * 3600000000 + {DELAY}000000 <= epoch_us(latest) AS gone FROM t JOIN c USING (symbol, slice)) --- """


@query("time_bars_streamed", _ARRIVED + "SELECT symbol, bar_id, make_timestamp((bar_id + 1) * 3600000000) AS date_time, min_by(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, max_by(price, (ts, seq)) AS close, sum(volume) AS cumulative_volume, count(*) AS cumulative_ticks FROM a WHERE gone AND NOT late GROUP BY symbol, bar_id", "cumulative_volume")
def _(spark, d):
    return streamed.time_bars_of(_buckets(spark, d), "H")


@query("late_ticks_streamed", _ARRIVED + "SELECT symbol, bar_id, count(*) AS late_ticks FROM a WHERE late GROUP BY symbol, bar_id")
def _(spark, d):
    return streamed.late_ticks_of(_buckets(spark, d))


def _written(df: DataFrame, form: str, *order: str, **options) -> str:
    """A folder of files whose names follow the rows' order."""
    path = scratch_path(df.sparkSession, f"{form}-files")
    df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*(c for c in order if c.startswith("_"))).write.format(form).options(**options).save(path)
    return path


@query("csv_ticks", "SELECT 'all' AS symbol, ts, row_number() OVER (ORDER BY seq) - 1 AS seq, price, volume FROM {ticks}")
def _(spark, d):
    rows = events_ticks(spark, d).select(F.col("seq").alias("_seq"), F.col("ts").alias("date_time"), "price", "volume")
    return S.ticks_from_csv(spark, _written(rows, "csv", "_seq", header=True, timestampNTZFormat=S.CSV_TIME))


@query("text_values", "SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, price AS x FROM {ticks}")
def _(spark, d):
    rows = events_ticks(spark, d).select(F.col("seq").alias("_seq"), F.col("price").cast("string").alias("value"))
    return S.text_floats(spark, _written(rows, "text", "_seq"))


_METRICS = {"tick": "1e0", "volume": "volume", "dollar": "price * volume"}
#: What a tick's metric signed by the tick rule is, and for each place among the signed ones (all, or those of a side)
#: the exponential mean of the last 50 at most, whose smoothing follows their number.
_IMBALANCES = """t AS (SELECT *, sign * {metric} AS b FROM {{signed}}),
  o AS (SELECT symbol, tick_index, {side} AS side, {size} AS b, row_number() OVER (PARTITION BY symbol, {side} ORDER BY tick_index) AS c FROM t {only}),
  m AS (SELECT x.symbol, x.side, x.c, sum(y.b * pow(1 - 2e0 / (least(x.c, 50) + 1), x.c - y.c)) / sum(pow(1 - 2e0 / (least(x.c, 50) + 1), x.c - y.c)) AS e FROM o x JOIN o y ON x.symbol = y.symbol AND x.side = y.side AND y.c BETWEEN x.c - 49 AND x.c GROUP BY 1, 2, 3)"""
#: The exponential mean of the last values of a list, by a window of so many.
_LAST_EWMA = "list_sum(list_transform({l}, lambda v, k: v * pow(1 - 2e0 / ({w} + 1), len({l}) - k))) / list_sum(list_transform({l}, lambda v, k: pow(1 - 2e0 / ({w} + 1), len({l}) - k)))"
_CLOSED_BARS = """ --- SELECT {bar} FROM (SELECT t.*, f.bar_id, last_value(CASE WHEN f.closed THEN f.lim END IGNORE NULLS) OVER g AS lim, bool_or(f.closed) OVER g AS is_full FROM t JOIN f USING (symbol, tick_index) WINDOW g AS (PARTITION BY t.symbol, f.bar_id ORDER BY t.tick_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE is_full GROUP BY symbol, bar_id"""


def _expected_ticks(expected: bool) -> str:
    """Of a row of f that has closed a bar: what the next one is expected to last, or is as before."""
    return f"CASE WHEN f.closed THEN least(greatest({_LAST_EWMA.format(l='f.lengths', w=5)}, 5e0), 100e0) ELSE f.et END" if expected else "20e0"


def _imbalance_sql(metric: str, expected: bool) -> str:
    """One signed sum a bar, against the expected length times the expected size of an imbalance."""
    ticks = "CASE WHEN f.closed THEN 1 ELSE f.ticks + 1 END"
    theta = "CASE WHEN f.closed THEN 0 ELSE f.theta END + i.b"
    mean = "coalesce(CASE WHEN f.closed THEN f.own ELSE f.e END, CASE WHEN i.tick_index >= 20 THEN i.own END)"
    return f"""WITH RECURSIVE {_IMBALANCES.format(metric=_METRICS[metric], side="0", size="b", only="")},
      i AS (SELECT t.symbol, t.tick_index, t.b, m.e AS own FROM t JOIN m ON m.symbol = t.symbol AND m.c = t.tick_index),
      f AS (SELECT symbol, tick_index, 0::BIGINT AS bar_id, 1 AS ticks, b AS theta, NULL::DOUBLE AS e, own, 20e0 AS et, []::INTEGER[] AS lengths, NULL::DOUBLE AS lim, FALSE AS closed FROM i WHERE tick_index = 1
      UNION ALL SELECT symbol, tick_index, bar_id, ticks, theta, e, own, et, CASE WHEN abs(theta) >= et * abs(e) THEN list_append(lengths, ticks)[-5:] ELSE lengths END, et * abs(e), coalesce(abs(theta) >= et * abs(e), FALSE)
      FROM (SELECT i.symbol, i.tick_index, f.bar_id + f.closed::BIGINT AS bar_id, {ticks} AS ticks, {theta} AS theta, {mean} AS e, i.own, {_expected_ticks(expected)} AS et, f.lengths FROM f JOIN i ON i.symbol = f.symbol AND i.tick_index = f.tick_index + 1))"""


def _run_sql(metric: str, expected: bool) -> str:
    """A sum for buys and one for sells a bar, against the expected length times the greater expected side."""
    reset = lambda c, more: f"CASE WHEN f.closed THEN 0 ELSE f.{c} END + {more}"
    share = _LAST_EWMA.format(l="f.shares", w=5 if expected else 50)
    # what a closed bar leaves; where any of it is unknown, all are estimated anew with this tick
    carried = {"e0": "CASE WHEN f.closed THEN f.own0 ELSE f.e0 END", "e1": "CASE WHEN f.closed THEN f.own1 ELSE f.e1 END", "bs": f"CASE WHEN f.closed THEN {share} ELSE f.bs END"}
    limit = "et * greatest(bs * e0, (1 - bs) * e1)"
    known = "et + e0 + e1 + bs IS NOT NULL"
    return f"""WITH RECURSIVE {_IMBALANCES.format(metric=_METRICS[metric], side="(sign < 0)::INTEGER", size="abs(b)", only="WHERE b <> 0")},
      n AS (SELECT symbol, tick_index, b, sum((b > 0)::INTEGER) OVER w AS n0, sum((b < 0)::INTEGER) OVER w AS n1 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY tick_index)),
      i AS (SELECT n.*, p.e AS own0, q.e AS own1 FROM n LEFT JOIN m p ON p.symbol = n.symbol AND p.side = 0 AND p.c = n.n0 LEFT JOIN m q ON q.symbol = n.symbol AND q.side = 1 AND q.c = n.n1),
      f AS (SELECT symbol, tick_index, 0::BIGINT AS bar_id, 1::BIGINT AS ticks, (b > 0)::BIGINT AS buys, greatest(b, 0)::DOUBLE AS up, greatest(-b, 0)::DOUBLE AS dn, NULL::DOUBLE AS e0, NULL::DOUBLE AS e1, (b > 0)::DOUBLE AS bs, own0, own1, 20e0 AS et, []::BIGINT[] AS lengths, []::DOUBLE[] AS shares, NULL::DOUBLE AS lim, FALSE AS closed FROM i WHERE tick_index = 1
      UNION ALL SELECT symbol, tick_index, bar_id, ticks, buys, up, dn, e0, e1, bs, own0, own1, et, CASE WHEN {known} AND greatest(up, dn) >= {limit} THEN list_append(lengths, ticks)[-5:] ELSE lengths END, CASE WHEN {known} AND greatest(up, dn) >= {limit} THEN list_append(shares, buys / ticks::DOUBLE)[-{5 if expected else 50}:] ELSE shares END, {limit}, {known} AND coalesce(greatest(up, dn) >= {limit}, FALSE)
      FROM (SELECT symbol, tick_index, bar_id, ticks, buys, up, dn, own0, own1, et, lengths, shares, CASE WHEN fresh THEN CASE WHEN n0 >= et THEN own0 END ELSE e0 END AS e0, CASE WHEN fresh THEN CASE WHEN n1 >= et THEN own1 END ELSE e1 END AS e1, CASE WHEN fresh THEN buys / ticks::DOUBLE ELSE bs END AS bs
      FROM (SELECT i.symbol, i.tick_index, i.n0, i.n1, f.bar_id + f.closed::BIGINT AS bar_id, {reset("ticks", "1")} AS ticks, {reset("buys", "(i.b > 0)::BIGINT")} AS buys, {reset("up", "greatest(i.b, 0)")} AS up, {reset("dn", "greatest(-i.b, 0)")} AS dn, {carried["e0"]} AS e0, {carried["e1"]} AS e1, {carried["bs"]} AS bs, {carried["e0"]} + {carried["e1"]} + {carried["bs"]} IS NULL AS fresh, i.own0, i.own1, {_expected_ticks(expected)} AS et, f.lengths, f.shares
      FROM f JOIN i ON i.symbol = f.symbol AND i.tick_index = f.tick_index + 1)))"""


def _information_bars(metric: str, family: str, expected: bool) -> None:
    name = f"{metric}_{family}_{'expected' if expected else 'fixed'}"
    more = {"ticks_window": 5, "bounds": (5.0, 100.0)} if expected else {}
    sql = (_imbalance_sql if family == "imbalance" else _run_sql)(metric, expected)

    @query(name, sql + _CLOSED_BARS.format(bar=_BAR.format(stamp="max(ts)", limit="any_value(lim)")), _BAR_DOUBLES + " threshold")
    def _(spark, d):
        return bars.build_bars(name, events_ticks(spark, d), expected_ticks=20.0, window=50, **more)


for _metric in bars.METRICS:
    for _family in ("imbalance", "run"):
        for _expected in (False, True):
            _information_bars(_metric, _family, _expected)


@query("ewma_full", "WITH RECURSIVE t AS (SELECT symbol, seq, tick_index, price FROM {signed}), f AS (SELECT symbol, seq, tick_index, price AS s, 1e0 AS w FROM t WHERE tick_index = 1 UNION ALL SELECT t.symbol, t.seq, t.tick_index, f.s * 0.9e0 + t.price, f.w * 0.9e0 + 1 FROM f JOIN t ON t.symbol = f.symbol AND t.tick_index = f.tick_index + 1) --- SELECT symbol, seq, s / w AS ewma FROM f", "ewma")
def _(spark, d):
    from ..functions.series import ewma

    return ewma(events_ticks(spark, d), "price", 19, order=("ts", "seq")).select("symbol", "seq", "ewma")


@query("ewma_price", "SELECT symbol, seq, sum(price_k * w) / sum(w) AS ewma FROM (SELECT a.symbol, a.seq, b.price AS price_k, pow(0.5, a.tick_index - b.tick_index) AS w FROM {signed} a JOIN {signed} b ON a.symbol = b.symbol AND b.tick_index BETWEEN a.tick_index - 19 AND a.tick_index) GROUP BY 1, 2", "ewma")
def _(spark, d):
    from ..functions.series import ewma_bounded

    t = events_ticks(spark, d)
    return t.select("symbol", "seq", ewma_bounded(F.col("price"), ordered("symbol", "ts", "seq"), 3.0, 20).alias("ewma"))


# ---- joins -----------------------------------------------------------------------------------------


@query("asof_backward", "SELECT d.symbol, d.ts, h.ts AS asof_ts, h.close FROM {daily} d ASOF LEFT JOIN {hourly} h ON d.symbol = h.symbol AND d.ts + INTERVAL 90 MINUTE >= h.ts")
def _(spark, d):
    left = daily(spark, d).select("symbol", "ts", (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("at"))
    right = hourly(spark, d).select("symbol", F.col("ts").alias("hts"), "close")
    return asof(left, right, "symbol", "at", "hts", ["close"]).select("symbol", "ts", F.col("asof_hts").alias("asof_ts"), "close")


@query("vertical_barrier", "SELECT a.symbol, a.ts AS event_start, min(b.ts) AS barrier FROM {daily} a JOIN {daily} b ON a.symbol = b.symbol AND b.ts >= a.ts + INTERVAL 3 DAY GROUP BY 1, 2")
def _(spark, d):
    p = daily(spark, d)
    return labels.vertical_barriers(p, p.select("symbol", F.col("ts").alias("event_start")), 3)


@query("interval_join", "SELECT e.symbol, e.event_start, count(*) AS n, sum(p.close) AS total FROM {evt} e JOIN {pos} p ON e.symbol = p.symbol AND p.pos BETWEEN e.p0 AND e.p1 GROUP BY 1, 2", "total")
def _(spark, d):
    p = positions(spark, d)
    e = span_events(spark, d).join(p.select("symbol", F.col("ts").alias("event_start"), F.col("pos").alias("p0")), ["symbol", "event_start"]).withColumn("p1", F.col("p0") + 3)
    return interval_join(e, p.select("symbol", "pos", "close"), "symbol", "p0", "p1", "pos", 8).groupBy("symbol", "event_start").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


# ---- labels and weights ----------------------------------------------------------------------------

_CUSUM = """WITH RECURSIVE f AS (
  SELECT symbol, pos, ts, close, 0e0 AS up, 0e0 AS dn, FALSE AS hit FROM {pos} WHERE pos = 1
  UNION ALL SELECT p.symbol, p.pos, p.ts, p.close,
    CASE WHEN NOT (least(0, f.dn + p.close - f.close) < -%(h)s) AND greatest(0, f.up + p.close - f.close) > %(h)s THEN 0 ELSE greatest(0, f.up + p.close - f.close) END,
    CASE WHEN least(0, f.dn + p.close - f.close) < -%(h)s THEN 0 ELSE least(0, f.dn + p.close - f.close) END,
    least(0, f.dn + p.close - f.close) < -%(h)s OR greatest(0, f.up + p.close - f.close) > %(h)s
  FROM f JOIN {pos} p ON p.symbol = f.symbol AND p.pos = f.pos + 1)
  --- SELECT symbol, ts AS event_start FROM f WHERE hit"""


@query("symmetric_cusum", _CUSUM % {"h": "40e0"})
def _(spark, d):
    return labels.cusum_events(daily(spark, d), 40.0)


@query("cusum_dynamic", _CUSUM.replace("%(h)s", "(p.close * 0.5e0 + 5)"))
def _(spark, d):
    return labels.cusum_events(daily(spark, d).withColumn("limit", F.col("close") * 0.5 + 5.0), "limit")


def _hourly_prices(spark, d):
    return hourly(spark, d).select("symbol", "ts", "close")


_VOL = """WITH r AS (SELECT a.symbol, a.ts, ln(a.close / nullif(b.close, 0)) AS r FROM {hourly} a ASOF JOIN {hourly} b ON a.symbol = b.symbol AND a.ts - INTERVAL 1 DAY > b.ts WHERE a.close > 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM r WHERE r IS NOT NULL),
  s AS (SELECT x.symbol, x.ts, x.k, sum(pow(19e0 / 21, x.k - y.k)) AS w, sum(pow(19e0 / 21, 2 * (x.k - y.k))) AS ww, sum(pow(19e0 / 21, x.k - y.k) * y.r) / sum(pow(19e0 / 21, x.k - y.k)) AS m FROM n x JOIN n y ON x.symbol = y.symbol AND y.k <= x.k GROUP BY ALL)
  --- SELECT s.symbol, s.ts, CASE WHEN s.k > 1 THEN sqrt(sum(pow(19e0 / 21, s.k - y.k) * (y.r - s.m) * (y.r - s.m)) / s.w * s.w * s.w / (s.w * s.w - s.ww)) END AS volatility FROM s JOIN n y ON s.symbol = y.symbol AND y.k <= s.k GROUP BY s.symbol, s.ts, s.k, s.w, s.ww"""


@query("daily_volatility", _VOL, "volatility")
def _(spark, d):
    return labels.daily_volatility(_hourly_prices(spark, d), 20)


_TRIPLE = """WITH w AS (SELECT a.symbol, a.ts AS event_start, a.close AS p0, b.ts AS barrier FROM {pos} a LEFT JOIN {pos} b ON a.symbol = b.symbol AND b.pos = a.pos + 5),
  x AS (SELECT w.symbol, w.event_start, w.barrier, min(CASE WHEN ln(p.close / p0) > 0.5 THEN p.ts END) AS won, min(CASE WHEN ln(p.close / p0) < -0.5 THEN p.ts END) AS lost
    FROM w JOIN {pos} p ON p.symbol = w.symbol AND p.ts >= w.event_start AND (w.barrier IS NULL OR p.ts <= w.barrier) GROUP BY ALL)
  --- SELECT symbol, event_start, least(barrier, won, lost) AS end_time FROM x"""


def _barrier_events(spark, d):
    p = positions(spark, d)
    later = p.select("symbol", (F.col("pos") - 5).alias("pos"), F.col("ts").alias("barrier"))
    e = p.join(later, ["symbol", "pos"], "left").select("symbol", F.col("ts").alias("event_start"), "barrier")
    return e.withColumn("base_width", F.lit(0.5)).withColumn("side", F.lit(1.0))


@query("triple_barrier", _TRIPLE)
def _(spark, d):
    return labels.triple_barrier(daily(spark, d), _barrier_events(spark, d), 1.0, 1.0).select("symbol", "event_start", "end_time")


@query("meta_labels", _TRIPLE.replace("--- SELECT symbol, event_start, least(barrier, won, lost) AS end_time FROM x", ", y AS (SELECT symbol, event_start, least(barrier, won, lost) AS end_time FROM x) --- SELECT y.symbol, y.event_start, y.end_time, ln(b.close) - ln(a.close) AS ret, sign(ln(b.close) - ln(a.close))::DOUBLE AS label FROM y JOIN {pos} a ON a.symbol = y.symbol AND a.ts = y.event_start JOIN {pos} b ON b.symbol = y.symbol AND b.ts = y.end_time"), "ret")
def _(spark, d):
    p = daily(spark, d)
    return labels.meta_labels(p, labels.triple_barrier(p, _barrier_events(spark, d), 1.0, 1.0).drop("side"))


_HOURLY_CUSUM = (_CUSUM % {"h": "60e0"}).replace("{pos}", "hp").split("RECURSIVE ")[1].split("---")[0]
_META = (
    f"WITH RECURSIVE hp AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, ts, close FROM {{hourly}}), {_HOURLY_CUSUM}, "
    + _VOL.split("WITH ", 1)[1].replace("  --- ", ", vol AS (")
    + """), ev AS (SELECT f.symbol, f.ts AS event_start, v.volatility AS base_width, f.close AS p0 FROM f JOIN vol v ON v.symbol = f.symbol AND v.ts = f.ts WHERE hit AND volatility > 0.01),
  vb AS (SELECT ev.symbol, event_start, min(h.ts) AS barrier FROM ev JOIN {hourly} h ON h.symbol = ev.symbol AND h.ts >= event_start + INTERVAL 1 DAY GROUP BY 1, 2),
  tb AS (SELECT ev.symbol, ev.event_start, any_value(base_width) AS base_width, any_value(barrier) AS barrier, min(CASE WHEN ln(h.close / p0) > base_width THEN h.ts END) AS won, min(CASE WHEN ln(h.close / p0) < -base_width THEN h.ts END) AS lost
    FROM ev LEFT JOIN vb ON vb.symbol = ev.symbol AND vb.event_start = ev.event_start JOIN {hourly} h ON h.symbol = ev.symbol AND h.ts >= ev.event_start AND (barrier IS NULL OR h.ts <= barrier) GROUP BY ev.symbol, ev.event_start)
  --- SELECT symbol, event_start, least(barrier, won, lost) AS end_time, base_width FROM tb"""
)


@query("meta_events", _META, "base_width")
def _(spark, d):
    p = _hourly_prices(spark, d)
    vol = labels.daily_volatility(p, 20)
    events = labels.cusum_events(p, 60.0)
    return labels.meta_events(p, events, vol, (1.0, 1.0), 0.01, labels.vertical_barriers(p, events, 1))


_CONC = "SELECT p.symbol, p.ts, count(e.event_start)::DOUBLE AS concurrency FROM {pos} p JOIN (SELECT symbol, min(event_start) AS lo, max(end_time) AS hi FROM {evt} GROUP BY 1) s ON p.symbol = s.symbol AND p.ts BETWEEN lo AND hi LEFT JOIN {evt} e ON e.symbol = p.symbol AND p.ts BETWEEN e.event_start AND e.end_time GROUP BY 1, 2"


@query("concurrency", _CONC)
def _(spark, d):
    return labels.concurrency(daily(spark, d), span_events(spark, d))


@query("avg_uniqueness", f"WITH c AS ({_CONC}) --- SELECT e.symbol, e.event_start, e.end_time, avg(1 / c.concurrency) AS uniqueness FROM {{evt}} e JOIN c ON c.symbol = e.symbol AND c.ts BETWEEN e.event_start AND e.end_time GROUP BY ALL", "uniqueness")
def _(spark, d):
    return labels.average_uniqueness(daily(spark, d), span_events(spark, d))


_ABS = f"c AS ({_CONC}), r AS (SELECT symbol, ts, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM {{pos}}), z AS (SELECT e.symbol, e.event_start, e.end_time, abs(sum(abs(r.r) / c.concurrency)) AS v FROM {{evt}} e JOIN c ON c.symbol = e.symbol AND c.ts BETWEEN e.event_start AND e.end_time LEFT JOIN r ON r.symbol = c.symbol AND r.ts = c.ts GROUP BY ALL), wt AS (SELECT symbol, event_start, end_time, v * count(*) OVER (PARTITION BY symbol) / sum(v) OVER (PARTITION BY symbol) AS weight FROM z)"


@query("abs_return_weights", f"WITH {_ABS} --- SELECT * FROM wt", "weight")
def _(spark, d):
    return labels.absolute_return_weights(daily(spark, d), span_events(spark, d))


@query("time_decay", f"WITH {_ABS} --- SELECT symbol, event_start, 0.5 + 0.5 * sum(weight) OVER (PARTITION BY symbol ORDER BY event_start) / sum(weight) OVER (PARTITION BY symbol) AS decay FROM wt", "decay")
def _(spark, d):
    return labels.time_decay(labels.absolute_return_weights(daily(spark, d), span_events(spark, d)), 0.5).select("symbol", "event_start", "decay")


_T = "regr_slope(y, x) / sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x), 0) / (count(y) - 2) / regr_sxx(y, x))"


@query("trend_tvalue", f"SELECT symbol, {_T} AS t_value FROM (SELECT symbol, close AS y, pos::DOUBLE AS x FROM {{pos}}) GROUP BY symbol", "t_value")
def _(spark, d):
    p = positions(spark, d).withColumn("x", F.col("pos").cast("double")).withColumnRenamed("close", "y")
    return p.groupBy("symbol").agg(labels.slope_t_value("y", "x").alias("t_value"))


@query("trend_scan", f"WITH f AS (SELECT a.symbol, a.ts AS event_start, s.span, coalesce({_T}, 0) AS t FROM {{pos}} a JOIN (SELECT unnest(range(3, 8)) AS span) s ON TRUE JOIN (SELECT symbol, pos AS q, close AS y, pos::DOUBLE AS x FROM {{pos}}) b ON a.symbol = b.symbol AND b.q >= a.pos AND b.q < a.pos + s.span GROUP BY ALL), e AS (SELECT a.symbol, a.ts AS event_start, b.ts AS end_time FROM {{pos}} a JOIN {{pos}} b ON a.symbol = b.symbol AND b.pos = a.pos + 7) --- SELECT e.symbol, e.event_start, e.end_time, arg_max(f.t, (abs(f.t), -f.span)) AS t_value, sign(arg_max(f.t, (abs(f.t), -f.span)))::DOUBLE AS trend FROM e JOIN f USING (symbol, event_start) GROUP BY ALL", "t_value")
def _(spark, d):
    p = daily(spark, d).select("symbol", "ts", "close")
    return labels.trend_scanning(p, p.select("symbol", F.col("ts").alias("event_start")), (3, 8))


# ---- fractional differences, entropy, microstructure, breaks ---------------------------------------


def _lags(weights) -> str:
    return " + ".join(f"{float(v)!r}::DOUBLE * " + ("close" if k == 0 else f"lag(close, {k}) OVER (PARTITION BY symbol ORDER BY ts)") for k, v in enumerate(weights))


@query("ffd_d04", f"SELECT symbol, ts, {_lags(fracdiff.fixed_weights(0.4, 0.01))} AS ffd FROM {{daily}}", "ffd")
def _(spark, d):
    return fracdiff.ffd(daily(spark, d).withColumnRenamed("close", "x"), 0.4, 0.01).select("symbol", "ts", "ffd")


#: Weights of (1 - lag) ** d by lag, as running products.
_BINOMIAL = "k AS (SELECT unnest(range(0, 20000)) AS k), bw AS (SELECT k, product(CASE WHEN k = 0 THEN 1 ELSE (k - 1 - {d}) / k END) OVER (ORDER BY k) AS w FROM k)"
_WIDE = "WITH h AS (SELECT symbol, ts, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM {hourly}), " + _BINOMIAL.format(d="0.4e0") + ", fw AS (SELECT k, w FROM bw WHERE k < (SELECT min(k) FROM bw WHERE abs(w) < 1e-4)) --- SELECT a.symbol, a.ts, any_value(a.x) AS x, CASE WHEN count(*) = (SELECT count(*) FROM fw) THEN sum(w * b.x) END AS ffd FROM h a JOIN h b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos - 20000 AND a.pos JOIN fw ON fw.k = a.pos - b.pos GROUP BY a.symbol, a.ts"
_EXPANDING = "WITH " + _BINOMIAL.format(d="0.5e0") + ", n AS (SELECT symbol, max(pos) AS n FROM {pos} GROUP BY 1), ls AS (SELECT symbol, n, k, sum(abs(w)) OVER (PARTITION BY symbol ORDER BY k DESC) / sum(abs(w)) OVER (PARTITION BY symbol) AS loss FROM n JOIN bw ON k < n), sk AS (SELECT symbol, sum((loss < 0.01)::INTEGER) AS skip FROM ls GROUP BY 1) --- SELECT a.symbol, a.ts, any_value(a.close) AS x, CASE WHEN a.pos > any_value(skip) THEN sum(w * b.close) END AS fracdiff FROM {pos} a JOIN {pos} b ON a.symbol = b.symbol AND b.pos <= a.pos JOIN bw ON k = a.pos - b.pos JOIN sk ON sk.symbol = a.symbol GROUP BY a.symbol, a.ts, a.pos"


@query("ffd_wide", _WIDE, "ffd")
def _(spark, d):
    return fracdiff.ffd(_hourly_prices(spark, d).withColumnRenamed("close", "x"), 0.4, 1e-4)


@query("fracdiff_expanding", _EXPANDING, "fracdiff")
def _(spark, d):
    return fracdiff.frac_diff_expanding(daily(spark, d).withColumnRenamed("close", "x"), 0.5)


def _orders_sql() -> str:
    """A difference of each order in tenths, and the least-squares statistics of its steps from second moments."""
    orders = " UNION ALL ".join(f"SELECT symbol, ts, close AS level, {float(v)!r}::DOUBLE AS d, {_lags(fracdiff.fixed_weights(v, 0.01))} AS x FROM lp" for v in np.linspace(0, 1, 11))
    tail = lambda c: " + ".join(f"{float(v)!r}::DOUBLE * pow(adf, {k})" for k, v in enumerate(c))
    return f"""WITH lp AS (SELECT symbol, ts, CASE WHEN close > 0 THEN ln(close) END AS close FROM {{hourly}}), u AS ({orders}),
  s AS (SELECT *, x - lag(x) OVER w AS y, lag(x) OVER w AS l, lag(x) OVER w - lag(x, 2) OVER w AS z FROM u WHERE x IS NOT NULL WINDOW w AS (PARTITION BY symbol, d ORDER BY ts)),
  c AS (SELECT symbol, d, abs(corr(x, level)) AS correlation, count(z) AS n, avg(y) FILTER (z IS NOT NULL) AS my, avg(l) FILTER (z IS NOT NULL) AS ml, avg(z) AS mz FROM s GROUP BY 1, 2),
  q AS (SELECT s.symbol, s.d, any_value(n) AS n, any_value(correlation) AS correlation, sum((l - ml) * (l - ml)) AS ll, sum((z - mz) * (z - mz)) AS zz, sum((y - my) * (y - my)) AS yy, sum((l - ml) * (z - mz)) AS lz, sum((l - ml) * (y - my)) AS ly, sum((z - mz) * (y - my)) AS zy FROM s JOIN c USING (symbol, d) WHERE z IS NOT NULL GROUP BY 1, 2),
  -- the level's step that the lagged step doesn't tell
  p AS (SELECT *, ll - lz * lz / zz AS own, ly - lz * zy / zz AS with_y, yy - zy * zy / zz AS rest FROM q), t AS (SELECT symbol, d, correlation, with_y / own / sqrt((rest - with_y * with_y / own) / (n - 3) / own) AS adf FROM p),
  f AS (SELECT *, CASE WHEN adf <= {DF_STAR!r} THEN {tail(DF_SMALL)} ELSE {tail(DF_LARGE)} END AS tail FROM t)
  --- SELECT symbol, d, adf, CASE WHEN adf > {DF_MAX!r} THEN 1 WHEN adf < {DF_MIN!r} THEN 0 ELSE {phi_sql("tail")} END AS p_value, correlation FROM f"""


@query("optimal_ffd", _orders_sql(), "d adf p_value correlation")
def _(spark, d):
    return fracdiff.optimal_ffd(_hourly_prices(spark, d))


@query("least_stationary_ffd")
def _(spark, d):
    return fracdiff.apply(_hourly_prices(spark, d).withColumnRenamed("close", "x"), lambda x: fracdiff.least_stationary_difference(x, 1e-3), "ffd")


@query("adaptive_ffd")
def _(spark, d):
    return fracdiff.adaptive_orders(_hourly_prices(spark, d))


_NGRAM = "WITH g AS (SELECT id, substr(message, i, {w}) AS word, count(*) AS n FROM (SELECT id, message, unnest(range(1, length(message) - {w} + 2)) AS i FROM {{msgs}}) GROUP BY 1, 2), s AS (SELECT id, sum(n)::DOUBLE AS total, sum(n * log2(n)) AS nlogn, count(*) AS kinds FROM g GROUP BY 1) --- "


@query("entropy_shannon", _NGRAM.format(w=1) + "SELECT id, log2(total) - nlogn / total AS entropy FROM s", "entropy")
def _(spark, d):
    return entropy.plug_in_entropy(messages(spark, d))


@query("plugin_entropy", _NGRAM.format(w=2) + "SELECT id, (log2(total) - nlogn / total) / 2 AS entropy FROM s", "entropy")
def _(spark, d):
    return entropy.plug_in_entropy(messages(spark, d), 2)


@query("miller_madow", _NGRAM.format(w=2) + f"SELECT id, (log2(total) - nlogn / total + (kinds - 1) / (2 * total * {math.log(2)!r})) / 2 AS entropy FROM s", "entropy")
def _(spark, d):
    return entropy.plug_in_entropy(messages(spark, d), 2, corrected=True)


@query("ngram_pmf", _NGRAM.format(w=2) + "SELECT g.id, g.word, g.n / s.total AS p FROM g JOIN s USING (id)", "p")
def _(spark, d):
    return entropy.mass_function(messages(spark, d), 2)


#: G(1) = G(0) = -gamma - ln 2, and G grows by 2 / (2 j - 1) at each even number 2 j, as a table over all counts met.
_GRASSBERGER = _NGRAM.format(w=1).replace(" --- ", f""", o AS (SELECT j, {-EULER - math.log(2)!r} + sum(CASE WHEN j > 0 THEN 2e0 / (2 * j - 1) ELSE 0 END) OVER (ORDER BY j) AS g FROM range((SELECT max(n) FROM g) // 2 + 1) r(j)),
  q AS (SELECT id, ln(sum(n)) - sum(n * o.g) / sum(n) AS nats FROM g JOIN o ON o.j = g.n // 2 GROUP BY 1) --- """)


@query("entropy_grassberger", _GRASSBERGER + f"SELECT id, coalesce(nats, 0) / {math.log(2)!r} AS entropy FROM {{msgs}} LEFT JOIN q USING (id)", "entropy")
def _(spark, d):
    return entropy.grassberger_entropy(messages(spark, d))


for _name in entropy.ESTIMATORS:
    QUERIES[f"entropy_{_name}"] = lambda spark, d, n=_name: rounded(entropy.message_entropy(messages(spark, d), n))


_CS = f"""WITH a AS (SELECT *, pow(ln(CASE WHEN high > 0 AND low > 0 THEN high / low END), 2) AS sq, row_number() OVER w AS k, max(high) OVER (w ROWS 1 PRECEDING) AS hi, min(low) OVER (w ROWS 1 PRECEDING) AS lo FROM {{hourly}} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  b AS (SELECT *, CASE WHEN count(sq) OVER (PARTITION BY symbol ORDER BY ts ROWS 1 PRECEDING) = 2 THEN sum(sq) OVER (PARTITION BY symbol ORDER BY ts ROWS 1 PRECEDING) END AS two FROM a),
  c AS (SELECT symbol, ts, k, CASE WHEN count(two) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) = 5 THEN avg(two) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) END AS beta, CASE WHEN k >= 2 AND hi > 0 AND lo > 0 THEN pow(ln(hi / lo), 2) END AS gamma FROM b),
  e AS (SELECT *, CASE WHEN beta IS NOT NULL AND gamma IS NOT NULL THEN greatest({math.sqrt(2) - 1!r} * sqrt(beta) / {microstructure.DENOMINATOR!r} - sqrt(gamma / {microstructure.DENOMINATOR!r}), 0) END AS alpha,
    CASE WHEN beta IS NOT NULL AND gamma IS NOT NULL THEN greatest({math.sqrt(2) - 1!r} * sqrt(beta) / {microstructure.DENOMINATOR!r} + sqrt(gamma / {8 / math.pi * microstructure.DENOMINATOR!r}), 0) END AS sigma FROM c) --- """


@query("cs_spread", _CS + "SELECT symbol, ts, beta, gamma, alpha, 2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS spread FROM e", "beta gamma alpha spread")
def _(spark, d):
    return microstructure.range_estimates(hourly(spark, d), 5).select("symbol", "ts", "beta", "gamma", "alpha", "spread")


@query("bp_vol", _CS + "SELECT symbol, ts, sigma FROM e", "sigma")
def _(spark, d):
    return microstructure.range_estimates(hourly(spark, d), 5).select("symbol", "ts", "sigma")


_EDGE = """WITH a AS (SELECT symbol, ts, ln(open) AS o, ln(high) AS h, ln(low) AS l, ln(close) AS c, (ln(high) + ln(low)) / 2 AS m FROM {hourly}),
  b AS (SELECT *, lag(h) OVER w AS h1, lag(l) OVER w AS l1, lag(c) OVER w AS c1, lag(m) OVER w AS m1 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  t AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN (h <> l OR l <> c1)::INTEGER::DOUBLE END AS tau, CASE WHEN c1 IS NOT NULL THEN m - o END AS r1, o - m1 AS r2, m - c1 AS r3, c1 - m1 AS r4, o - c1 AS r5 FROM b),
  q AS (SELECT symbol, avg(tau) AS pt, avg(r1) AS a1, avg(r3) AS a3, avg(r5) AS a5, avg((tau = 1 AND o <> h)::INTEGER::DOUBLE) + avg((tau = 1 AND o <> l)::INTEGER::DOUBLE) AS po, avg((tau = 1 AND c1 <> h1)::INTEGER::DOUBLE) + avg((tau = 1 AND c1 <> l1)::INTEGER::DOUBLE) AS pc FROM t WHERE tau IS NOT NULL GROUP BY 1),
  x AS (SELECT t.symbol, -4 / po * (r1 - a1 / pt * tau) * r2 - 4 / pc * (r3 - a3 / pt * tau) * r4 AS x1, -4 / po * (r1 - a1 / pt * tau) * r5 - 4 / pc * (r5 - a5 / pt * tau) * r4 AS x2 FROM t JOIN q USING (symbol)),
  s AS (SELECT symbol, avg(x1) AS e1, avg(x2) AS e2, avg(x1 * x1) - avg(x1) * avg(x1) AS v1, avg(x2 * x2) - avg(x2) * avg(x2) AS v2 FROM x GROUP BY 1) --- SELECT symbol, sqrt(abs((v2 * e1 + v1 * e2) / (v1 + v2))) AS spread FROM s"""


@query("edge_spread", _EDGE, "spread")
def _(spark, d):
    return microstructure.edge_spread(hourly(spark, d))


_PSY = """WITH v AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r, ln(close) AS x FROM {daily}), n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY symbol ORDER BY r) - x, 0) AS d FROM v),
  p AS (SELECT symbol, ts, r, coalesce(sum(x) OVER w, 0) AS sx, coalesce(sum(x * x) OVER w, 0) AS sxx, coalesce(sum(d) OVER w, 0) AS sd, coalesce(sum(x * d) OVER w, 0) AS sxd, coalesce(sum(d * d) OVER w, 0) AS sdd FROM n WINDOW w AS (PARTITION BY symbol ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  j AS (SELECT b.symbol, b.ts, b.r AS r2, a.r AS r1, (b.r - a.r)::DOUBLE AS n, b.sx - a.sx AS sx, b.sxx - a.sxx AS sxx, b.sd - a.sd AS sd, b.sxd - a.sxd AS sxd, b.sdd - a.sdd AS sdd FROM p b JOIN p a ON a.symbol = b.symbol AND a.r <= b.r - 8),
  k AS (SELECT *, n * sxx - sx * sx AS den, (n * sxd - sx * sd) / (n * sxx - sx * sx) AS beta FROM j), l AS (SELECT *, greatest(sdd - (sd - beta * sx) / n * sd - beta * sxd, 0) / (n - 2) * n / den AS var FROM k),
  m AS (SELECT symbol, ts, (r2 + 1)::BIGINT AS pos, max(CASE WHEN r1 = 0 THEN beta / sqrt(var) END) AS sadf, max(beta / sqrt(var)) AS bsadf FROM l WHERE den > 0 AND var > 0 GROUP BY 1, 2, 3) --- """


def _log_daily(spark, d):
    return daily(spark, d).select("symbol", "ts", F.ln("close").alias("x"))


@query("sadf_seq", _PSY + "SELECT symbol, ts, pos, sadf, bsadf FROM m", "sadf bsadf")
def _(spark, d):
    return breaks.psy_sequences(_log_daily(spark, d), 8)


@query("gsadf", _PSY + "SELECT symbol, max(sadf) AS sadf, max(bsadf) AS gsadf FROM m GROUP BY 1", "sadf gsadf")
def _(spark, d):
    return breaks.gsadf(_log_daily(spark, d), 8)


@query("bubble_episodes", _PSY.replace(" --- ", ", a AS (SELECT symbol, pos, bsadf > -1 AS up, lead(pos) OVER w AS nxt, lag(bsadf > -1) OVER w AS was FROM m WINDOW w AS (PARTITION BY symbol ORDER BY pos)), g AS (SELECT *, sum((up <> coalesce(was, FALSE))::INTEGER) OVER (PARTITION BY symbol ORDER BY pos) AS run FROM a) --- ") + "SELECT symbol, min(pos) AS start, max(coalesce(nxt, pos)) AS collapse, count(*) AS length FROM g WHERE up GROUP BY symbol, run")
def _(spark, d):
    return breaks.bubble_episodes(breaks.psy_sequences(_log_daily(spark, d), 8), "bsadf", -1.0)


@query("cusum_csw", "WITH v AS (SELECT symbol, pos, ln(close) AS x, sum(pow(ln(close) - lag_x, 2)) OVER (PARTITION BY symbol ORDER BY pos) / nullif(pos - 1, 0) AS var FROM (SELECT *, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY pos) AS lag_x FROM {pos})) --- SELECT a.symbol, a.pos, max(abs(a.x - b.x) / sqrt(a.var * (a.pos - b.pos))) AS csw, arg_max(b.pos, (round(abs(a.x - b.x) / sqrt(a.var * (a.pos - b.pos)), 12), -b.pos)) AS start FROM v a JOIN v b ON a.symbol = b.symbol AND b.pos < a.pos WHERE a.var > 0 GROUP BY 1, 2", "csw")
def _(spark, d):
    return breaks.chu_stinchcombe_white(_log_daily(spark, d))


@query("lagged_close", "SELECT symbol, ts, close AS close_lag0, lag(close, 1) OVER w AS close_lag1, lag(close, 2) OVER w AS close_lag2 FROM {daily} WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def _(spark, d):
    return breaks.lagged(daily(spark, d), "close", 2).select("symbol", "ts", "close_lag0", "close_lag1", "close_lag2")


@query("adf_design", "WITH v AS (SELECT symbol, ts, pos, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS dx FROM {pos}) --- SELECT * FROM (SELECT symbol, ts, pos, dx AS y, lag(close) OVER w AS level, lag(dx, 1) OVER w AS delta1, 1e0 AS constant, pos::DOUBLE AS trend FROM v WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE pos > 2", "y delta1")
def _(spark, d):
    return breaks.adf_design(daily(spark, d).withColumnRenamed("close", "x"), "ct", 1).withColumn("pos", F.col("pos").cast("long"))


#: The same search on lists: places met, their least costs and origins, and the starts kept after each.
_PELT = """WITH RECURSIVE sr AS (SELECT symbol, count(*) AS n, 3 * ln(count(*)) AS beta, list_prepend(0e0, list(c1 ORDER BY ts)) AS c1, list_prepend(0e0, list(c2 ORDER BY ts)) AS c2
    FROM (SELECT symbol, ts, sum(close) OVER w AS c1, sum(close * close) OVER w AS c2 FROM {hourly} WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY 1 HAVING count(*) >= 20),
  st AS (SELECT symbol, 0::BIGINT AS stop, [0::BIGINT] AS met, [0e0] AS best, [NULL::BIGINT] AS origin, []::BIGINT[] AS starts FROM sr UNION ALL
    SELECT symbol, stop, list_append(met, stop), list_append(best, least_cost), list_append(origin, usable[list_position(total, least_cost)]),
      list_transform(list_filter(list_zip(starts, total), lambda z: z[2] <= least_cost + beta), lambda z: z[1])
    FROM (SELECT *, list_min(total) AS least_cost FROM (SELECT *, list_transform(usable, lambda s: best[list_position(met, s)] + beta + (stop - s) * ln(greatest((c2[stop + 1] - c2[s + 1]) / (stop - s) - pow((c1[stop + 1] - c1[s + 1]) / (stop - s), 2), 0) + 1e-6)) AS total
      FROM (SELECT *, list_filter(starts, lambda s: list_contains(met, s)) AS usable
        FROM (SELECT symbol, n, beta, c1, c2, met, best, origin, next AS stop, list_append(starts, (next - 10) // 5 * 5) AS starts
          FROM (SELECT st.*, sr.n, sr.beta, sr.c1, sr.c2, CASE WHEN greatest(stop + 5, 10) < sr.n THEN greatest(stop + 5, 10) ELSE sr.n END AS next FROM st JOIN sr USING (symbol) WHERE stop < sr.n)))))),
  tr AS (SELECT symbol, met, origin, n AS place FROM st JOIN sr USING (symbol) WHERE stop = n UNION ALL SELECT symbol, met, origin, origin[list_position(met, place)] FROM tr WHERE place > 0)
  --- SELECT symbol, place AS change_point FROM tr JOIN sr USING (symbol) WHERE place > 0 AND place < n"""


@query("pelt_change_points", _PELT)
def _(spark, d):
    return breaks.pelt(_hourly_prices(spark, d).withColumnRenamed("close", "x"))


def _least_squares_sql(regressors: dict[str, str], order: str) -> str:
    """CTEs that end in fit: symbol, pos, n, coefficients b0.., residual squares and the inverse's first entry, over
    all rows of a design up to each in that order.

    Running sums of products of the regressors and y are swept by one regressor after another.
    """
    names = [*regressors, "y"]
    m = len(regressors)
    cell = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    cells = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    columns = ", ".join(f"{e} AS {c}" for c, e in regressors.items())
    sql = f"""WITH v AS (SELECT symbol, pos, ln(close) AS x, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY pos) AS dx FROM {{pos}}),
  z AS (SELECT symbol, pos, dx AS y, {columns} FROM v WINDOW w AS (PARTITION BY symbol ORDER BY pos) QUALIFY pos > 2),
  s0 AS (SELECT symbol, pos, y, {", ".join(regressors)}, count(*) OVER w AS n, {", ".join(f"sum({names[i]} * {names[j]}) OVER w AS {cell(i, j)}" for i, j in cells)} FROM z WINDOW w AS (PARTITION BY symbol ORDER BY pos {order} ROWS UNBOUNDED PRECEDING))"""
    for k in range(m):
        d = cell(k, k)
        swept = [f"-1 / {d}" if (i, j) == (k, k) else f"{cell(i, j)} / {d}" if k in (i, j) else f"{cell(i, j)} - {cell(i, k)} * {cell(k, j)} / {d}" for i, j in cells]
        sql += f""",
  s{k + 1} AS (SELECT symbol, pos, y, {", ".join(regressors)}, n, {", ".join(f"{e} AS {cell(i, j)}" for e, (i, j) in zip(swept, cells))} FROM s{k})"""
    inverse = ", ".join(f"-{cell(i, j)} AS p{i}_{j}" for i in range(m) for j in range(i, m))
    return sql + f""",
  fit AS (SELECT symbol, pos, y, {", ".join(regressors)}, n, {", ".join(f"{cell(k, m)} AS b{k}" for k in range(m))}, {cell(m, m)} AS rest, {inverse} FROM s{m}),
  t AS (SELECT symbol, pos, n, b0 / sqrt(rest / (n - {m}) * p0_0) AS t FROM fit WHERE n >= 10) --- """


_REGRESSORS = {"level": "lag(x) OVER w", "delta1": "lag(dx) OVER w", "one": "1e0", "trend": "pos::DOUBLE"}
_C, _CT = ({k: v for k, v in _REGRESSORS.items() if k != "trend"}, _REGRESSORS)
_BDE = _least_squares_sql(_C, "ASC").replace(" --- ", """,
  b AS (SELECT symbol, pos, y, level, delta1, one, lag(n) OVER w AS n, lag(b0) OVER w AS b0, lag(b1) OVER w AS b1, lag(b2) OVER w AS b2, lag(p0_0) OVER w AS p0_0, lag(p0_1) OVER w AS p0_1, lag(p0_2) OVER w AS p0_2, lag(p1_1) OVER w AS p1_1, lag(p1_2) OVER w AS p1_2, lag(p2_2) OVER w AS p2_2 FROM fit WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
  e AS (SELECT symbol, pos, (y - b0 * level - b1 * delta1 - b2) / sqrt(1 + p0_0 * level * level + p1_1 * delta1 * delta1 + p2_2 + 2 * (p0_1 * level * delta1 + p0_2 * level + p1_2 * delta1)) AS error FROM b WHERE n > 3) --- """)


@query("brown_durbin_evans", _BDE + "SELECT symbol, pos, sum(error) OVER (PARTITION BY symbol ORDER BY pos) / stddev_samp(error) OVER (PARTITION BY symbol) AS cusum FROM e", "cusum")
def _(spark, d):
    return breaks.brown_durbin_evans(_log_daily(spark, d))


_CHOW = """WITH v AS (SELECT symbol, pos - 1 AS t, ln(close) AS x, lead(ln(close)) OVER (PARTITION BY symbol ORDER BY pos) - ln(close) AS d, count(*) OVER (PARTITION BY symbol) AS n FROM {pos}),
  s AS (SELECT k.symbol, k.t AS pos, any_value(k.n) AS n, sum(v.x * v.x) FILTER (v.t >= k.t) AS xx, sum(v.x * v.d) FILTER (v.t >= k.t) AS xd, sum(v.d * v.d) AS dd FROM v k JOIN v ON v.symbol = k.symbol AND v.d IS NOT NULL WHERE k.t >= 5 AND k.t < k.n - 6 GROUP BY 1, 2)
  --- SELECT symbol, pos, xd / xx / sqrt((dd - xd * xd / xx) / (n - 2) / xx) AS dfc FROM s"""


@query("chow_dickey_fuller", _CHOW, "dfc")
def _(spark, d):
    return breaks.chow_dickey_fuller(_log_daily(spark, d), 5)


@query("expanding_adf", _least_squares_sql(_CT, "ASC") + "SELECT symbol, pos, t AS adf FROM t", "adf")
def _(spark, d):
    return breaks.expanding_adf(_log_daily(spark, d), 10, "ct", 1)


@query("backward_sup_adf", _least_squares_sql(_CT, "DESC") + "SELECT symbol, max(t) AS bsadf FROM t GROUP BY symbol", "bsadf")
def _(spark, d):
    return breaks.backward_sup_adf(_log_daily(spark, d), 10, "ct", 1)


@query("quantile_adf", _least_squares_sql(_C, "DESC") + "SELECT symbol, any_value(sadf) AS sadf, any_value(qadf) AS qadf, avg(t) FILTER (t >= qadf) AS cadf FROM (SELECT symbol, t, max(t) OVER g AS sadf, quantile_cont(t, 0.95) OVER g AS qadf FROM t WINDOW g AS (PARTITION BY symbol)) GROUP BY symbol", "sadf qadf cadf")
def _(spark, d):
    return breaks.quantile_adf(_log_daily(spark, d), 10)


@query("robust_sadf")
def _(spark, d):
    return breaks.volatility_robust_sadf(_log_daily(spark, d), 8, 49)


@query("psy_critical_values")
def _(spark, d):
    return breaks.simulate_critical_values(spark, 40, 10, 200)[0]


# ---- dependence ------------------------------------------------------------------------------------


def _pairs(spark, d):
    return events_ticks(spark, d).select("symbol", "seq", F.col("price").alias("x"), F.col("volume").alias("y"))


_BIN = "CASE WHEN max({c}) OVER g = min({c}) OVER g THEN 1 ELSE least(floor(({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) * 10) + 1, 10) END"
_INFO = f"WITH b AS (SELECT symbol, {_BIN.format(c='price')} AS bx, {_BIN.format(c='volume')} AS vy FROM {{ticks}} WINDOW g AS (PARTITION BY symbol)), c AS (SELECT symbol, bx, vy, count(*)::DOUBLE AS n FROM b GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY symbol, bx) AS nx, sum(n) OVER (PARTITION BY symbol, vy) AS ny, sum(n) OVER (PARTITION BY symbol) AS t FROM c), h AS (SELECT symbol, sum(-n / t * ln(nx / t)) AS h_x, sum(-n / t * ln(ny / t)) AS h_y, sum(-n / t * ln(n / t)) AS h_xy FROM e GROUP BY 1) --- "


@query("variation_of_information", _INFO + "SELECT symbol, 2 * h_xy - h_x - h_y AS vi, (2 * h_xy - h_x - h_y) / h_xy AS vi_norm FROM h", "vi vi_norm")
def _(spark, d):
    return dependence.information(_pairs(spark, d), "x", "y", 10).select("symbol", "vi", "vi_norm")


@query("mutual_information", _INFO + "SELECT symbol, h_x, h_y, h_x + h_y - h_xy AS mi, (h_x + h_y - h_xy) / least(h_x, h_y) AS mi_norm FROM h", "h_x h_y mi mi_norm")
def _(spark, d):
    return dependence.information(_pairs(spark, d), "x", "y", 10).select("symbol", "h_x", "h_y", "mi", "mi_norm")


_OWN_BINS = """WITH n AS (SELECT symbol, count(*) AS n, corr(price, volume) AS r, min(price) AS x0, max(price) AS x1, min(volume) AS y0, max(volume) AS y1 FROM {ticks} GROUP BY 1),
  k AS (SELECT *, round_even(pow(2e0, -0.5e0) * sqrt(1 + sqrt(1 + 24 * n / (1 - r * r))), 0)::BIGINT AS bins FROM n),
  b AS (SELECT symbol, bins, least(floor((price - x0) / (x1 - x0) * bins) + 1, bins) AS bx, least(floor((volume - y0) / (y1 - y0) * bins) + 1, bins) AS vy FROM {ticks} JOIN k USING (symbol)),
  c AS (SELECT symbol, bins, bx, vy, count(*)::DOUBLE AS n FROM b GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY symbol, bx) AS nx, sum(n) OVER (PARTITION BY symbol, vy) AS ny, sum(n) OVER (PARTITION BY symbol) AS t FROM c)
  --- SELECT symbol, bins, sum(n / t * (ln(nx / t) + ln(ny / t) - 2 * ln(n / t))) AS vi FROM e GROUP BY 1, 2"""


@query("vi_extended", _OWN_BINS, "vi")
def _(spark, d):
    return dependence.variation_of_information_extended(_pairs(spark, d), "x", "y")


#: Both axes with their jitter, all pairs of a symbol, the k-th neighbour of each point and the margins.
_JITTERED = "x + (((seq % 2147483648) * {0} % 4294967296) / 4294967296e0 - 0.5e0) * stddev_pop(x) OVER g * 1e-10 AS x, y + (((seq % 2147483648) * {1} % 4294967296) / 4294967296e0 - 0.5e0) * stddev_pop(y) OVER g * 1e-10 AS y".format(*neighbours.JITTER.values())
_KSG = f"""WITH t AS (SELECT symbol, seq, price AS x, volume AS y FROM {{ticks}}), p AS (SELECT symbol, seq, count(*) OVER g AS n, {_JITTERED} FROM t WINDOW g AS (PARTITION BY symbol)),
  r AS (SELECT a.symbol, a.seq, a.n, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[5] * (1 - 1e-10) AS r FROM p a JOIN p b USING (symbol) GROUP BY ALL),
  m AS (SELECT a.symbol, a.seq, a.n, sum((abs(a.x - b.x) <= r)::INT) AS nx, sum((abs(a.y - b.y) <= r)::INT) AS ny FROM p a JOIN r ON a.symbol = r.symbol AND a.seq = r.seq JOIN p b ON b.symbol = a.symbol GROUP BY ALL),
  h AS (SELECT v, sum(1e0 / v) OVER (ORDER BY v) AS h FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM p))) AS v)), psi AS (SELECT v + 1 AS v, h - 0.5772156649015329e0 AS psi FROM h UNION ALL SELECT 1, -0.5772156649015329e0),
  ksg AS (SELECT m.symbol, any_value(k.psi) + any_value(q.psi) - avg(a.psi + b.psi) AS ksg FROM m JOIN psi a ON a.v = greatest(m.nx, 1) JOIN psi b ON b.v = greatest(m.ny, 1) JOIN psi q ON q.v = m.n JOIN psi k ON k.v = 4 GROUP BY m.symbol)"""
_DCOR = """d AS (SELECT a.symbol, a.seq, count(*) AS n, avg(abs(a.price - b.price)) AS mx, avg(abs(a.volume - b.volume)) AS my, avg(abs(a.price - b.price) * abs(a.volume - b.volume)) AS xy, avg(pow(a.price - b.price, 2)) AS xx, avg(pow(a.volume - b.volume, 2)) AS yy FROM {ticks} a JOIN {ticks} b USING (symbol) GROUP BY ALL),
  v AS (SELECT symbol, avg(xy) - 2 * avg(mx * my) + avg(mx) * avg(my) AS cxy, avg(xx) - 2 * avg(mx * mx) + pow(avg(mx), 2) AS cxx, avg(yy) - 2 * avg(my * my) + pow(avg(my), 2) AS cyy FROM d GROUP BY symbol),
  dcor AS (SELECT symbol, sqrt(greatest(cxy, 0) / sqrt(cxx * cyy)) AS dcor FROM v)"""


@query("ksg_information", _KSG + " --- SELECT * FROM ksg", "ksg")
def _(spark, d):
    return neighbours.ksg_information(_pairs(spark, d), "x", "y")


@query("distance_correlation", "WITH " + _DCOR + " --- SELECT * FROM dcor", "dcor")
def _(spark, d):
    return dependence.distance_correlations(_pairs(spark, d), "x", "y")


@query("ksg_and_dcor", _KSG + ", " + _DCOR + " --- SELECT symbol, ksg, dcor FROM ksg JOIN dcor USING (symbol)", "ksg dcor")
def _(spark, d):
    p = _pairs(spark, d)
    return neighbours.ksg_information(p, "x", "y").join(dependence.distance_correlations(p, "x", "y"), "symbol")


def _hours(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.hour("ts").alias("h")).agg(F.count(F.lit(1)).cast("double").alias("p"), F.sum("value").alias("q"))


_KL = "WITH a AS (SELECT event_type AS symbol, hour(ts) AS h, count(*)::DOUBLE AS p, sum(value) AS q FROM events GROUP BY 1, 2), b AS (SELECT symbol, p / sum(p) OVER (PARTITION BY symbol) AS p, q / sum(q) OVER (PARTITION BY symbol) AS q FROM a) --- "


@query("divergences", _KL + "SELECT symbol, sum(p * ln(p / q)) AS kl, -sum(p * ln(q)) AS cross_entropy FROM b GROUP BY 1", "kl cross_entropy")
def _(spark, d):
    return dependence.divergences(_hours(spark, d))


# ---- backtest --------------------------------------------------------------------------------------


@query("sharpe_by_symbol", "SELECT symbol, (avg(x) - 0.001) / stddev_pop(x) AS sharpe FROM {returns} GROUP BY 1", "sharpe")
def _(spark, d):
    return returns(spark, d).groupBy("symbol").agg(B.sharpe("x", 0.001).alias("sharpe"))


def _positions(spark, d):
    return returns(spark, d).withColumn("position", F.when(F.col("x") > 0.3, 1.0).when(F.col("x") < -0.3, -1.0).otherwise(0.0))


_POSN = "SELECT symbol, ts, CASE WHEN x > 0.3 THEN 1e0 WHEN x < -0.3 THEN -1e0 ELSE 0e0 END AS position FROM {returns}"


@query("bet_timing", f"WITH p AS ({_POSN}), l AS (SELECT *, lag(position) OVER w AS was, lead(ts) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)) --- SELECT symbol, ts FROM l WHERE (position = 0 AND was <> 0) OR position * was < 0 OR last")
def _(spark, d):
    return B.bet_timing(_positions(spark, d))


_HOLD = f"""WITH RECURSIVE p AS ({_POSN}), o AS (SELECT symbol, ts, position, row_number() OVER w AS k, (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 86400e6 AS dd FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  f AS (SELECT symbol, k, ts, position, 0e0 AS entry, NULL::DOUBLE AS days, NULL::DOUBLE AS weight FROM o WHERE k = 1
    UNION ALL SELECT o.symbol, o.k, o.ts, o.position,
      CASE WHEN (o.position - f.position) * f.position >= 0 THEN CASE WHEN o.position <> 0 THEN (f.entry * f.position + o.dd * (o.position - f.position)) / o.position ELSE f.entry END WHEN o.position * f.position < 0 THEN o.dd ELSE f.entry END,
      CASE WHEN (o.position - f.position) * f.position < 0 THEN o.dd - f.entry END, CASE WHEN (o.position - f.position) * f.position < 0 THEN CASE WHEN o.position * f.position < 0 THEN abs(f.position) ELSE abs(o.position - f.position) END END
    FROM f JOIN o ON o.symbol = f.symbol AND o.k = f.k + 1) --- """


@query("holding_period", _HOLD + "SELECT symbol, ts, days, weight FROM f WHERE days IS NOT NULL", "days weight")
def _(spark, d):
    return B.holding_periods(_positions(spark, d))


@query("mean_holding_period", _HOLD + "SELECT symbol, sum(days * weight) / sum(weight) AS mean_days FROM f GROUP BY 1", "mean_days")
def _(spark, d):
    return B.mean_holding_period(_positions(spark, d))


@query("hhi_concentration", "WITH r AS (SELECT * FROM {returns}), m AS (SELECT symbol, date_trunc('week', ts) AS m, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2) --- SELECT symbol, (sum(x * x) FILTER (x >= 0) / pow(sum(x) FILTER (x >= 0), 2) - 1 / count(*) FILTER (x >= 0)) / (1 - 1 / count(*) FILTER (x >= 0)) AS positive, (sum(x * x) FILTER (x < 0) / pow(sum(x) FILTER (x < 0), 2) - 1 / count(*) FILTER (x < 0)) / (1 - 1 / count(*) FILTER (x < 0)) AS negative FROM r GROUP BY 1", "positive negative")
def _(spark, d):
    return B.hhi_concentration(returns(spark, d)).select("symbol", "positive", "negative")


@query("drawdowns", "WITH h AS (SELECT symbol, ts, pnl, max(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS high FROM {daily}) --- SELECT symbol, min(ts) AS start, high, high - min(pnl) AS drawdown, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 86400 / 365.25 AS time_under_water FROM h GROUP BY symbol, high HAVING count(*) > 1 AND min(pnl) <> high", "drawdown time_under_water high")
def _(spark, d):
    return B.drawdowns(daily(spark, d), "pnl", True)


_DRAWDOWN = """WITH r AS (SELECT symbol, row_number() OVER w AS pos, exp(sum(ln(1 + x / 20)) OVER w) AS v FROM {returns} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  w AS (SELECT a.symbol, a.pos AS s, b.pos, 1 - b.v / max(b.v) OVER (PARTITION BY a.symbol, a.pos ORDER BY b.pos) AS dd FROM r a JOIN r b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos AND a.pos + 9 JOIN r z ON z.symbol = a.symbol AND z.pos = a.pos + 9),
  m AS (SELECT symbol, s, max(dd) AS dd FROM w GROUP BY 1, 2), k AS (SELECT symbol, dd, row_number() OVER (PARTITION BY symbol ORDER BY dd DESC) AS rk, 0.1e0 * count(*) OVER (PARTITION BY symbol) AS k FROM m)
  --- SELECT symbol, sum(dd * greatest(least(k - rk + 1, 1), 0)) / any_value(k) AS ced FROM k GROUP BY symbol"""


@query("expected_drawdown", _DRAWDOWN, "ced")
def _(spark, d):
    return B.conditional_expected_drawdown(returns(spark, d).withColumn("x", F.col("x") / 20), 10)


_NW = "WITH c AS (SELECT symbol, ts, x - avg(x) OVER (PARTITION BY symbol) AS c FROM {returns}), l AS (SELECT symbol, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts)) --- "


@query("newey_west", _NW + f"SELECT symbol, greatest((sum(c * c) + {2 * (1 - 1 / 3)!r} * sum(c * c1) + {2 * (1 - 2 / 3)!r} * sum(c * c2)) / count(*), 1e-12) AS variance FROM l GROUP BY 1", "variance")
def _(spark, d):
    return B.newey_west(returns(spark, d), 2)


_INFERENCE = f"""WITH m AS (SELECT symbol, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, greatest(floor(4 * pow(count(*) / 100e0, 2e0 / 9)), 1)::BIGINT AS lag FROM {{returns}} GROUP BY 1),
  p AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, (x - m) / sd - 0.5e0 * (m / sd) * (pow((x - m) / sd, 2) - 1) AS i FROM {{returns}} JOIN m USING (symbol)),
  c AS (SELECT symbol, pos, i - avg(i) OVER (PARTITION BY symbol) AS i FROM p),
  v AS (SELECT a.symbol, greatest(sum(CASE WHEN a.pos = b.pos THEN 1 ELSE 2 * (1 - (a.pos - b.pos) / (lag + 1e0)) END * a.i * b.i) / any_value(n), 1e-12) AS v FROM c a JOIN m ON m.symbol = a.symbol JOIN c b ON b.symbol = a.symbol AND b.pos BETWEEN a.pos - lag AND a.pos GROUP BY 1),
  s AS (SELECT symbol, lag, m / sd AS sharpe_ratio, sqrt(v / n) AS standard_error FROM m JOIN v USING (symbol)),
  t AS (SELECT *, sharpe_ratio - {norm_ppf(0.975)!r} * standard_error AS lower, sharpe_ratio + {norm_ppf(0.975)!r} * standard_error AS upper, sharpe_ratio / standard_error AS test_statistic FROM s),
  u AS (SELECT *, 2 * {phi_sql("-abs(test_statistic)")} AS p_value FROM t) --- SELECT symbol, sharpe_ratio, standard_error, lower, upper, test_statistic, p_value, p_value < 0.05 AS significant, lag FROM u"""


@query("sharpe_inference", _INFERENCE, "sharpe_ratio standard_error lower upper test_statistic p_value")
def _(spark, d):
    return B.sharpe_inferences(returns(spark, d))


def _return_pairs(spark, d):
    return returns(spark, d).withColumn("b", F.lag("x").over(ordered("symbol", "ts"))).filter("b IS NOT NULL").withColumnRenamed("x", "a")


@query("sharpe_difference")
def _(spark, d):
    return B.sharpe_differences(_return_pairs(spark, d), draws=199)


def _sharpe_difference_sql(band: str) -> str:
    influence = lambda c: f"g{c} / pow(s{c}, 3) * ({c} - m{c}) - m{c} / (2 * pow(s{c}, 3)) * ({c} * {c} - g{c})"
    return f"""WITH ab AS (SELECT symbol, ts, x AS a, lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM {{returns}} QUALIFY b IS NOT NULL),
  mo AS (SELECT symbol, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS ga, avg(b * b) AS gb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, {band} AS band FROM ab GROUP BY 1),
  i AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, n, band, ma / sa - mb / sb AS delta, {influence("a")} - ({influence("b")}) AS v FROM ab JOIN mo USING (symbol)),
  lr AS (SELECT x.symbol, any_value(x.delta) AS delta, sqrt(sum(x.v * y.v * CASE WHEN x.k = y.k THEN 1 ELSE 2 * (1 - (x.k - y.k) / (x.band + 1e0)) END) / any_value(x.n) / any_value(x.n)) AS se FROM i x JOIN i y ON x.symbol = y.symbol AND y.k BETWEEN x.k - x.band AND x.k GROUP BY 1),
  z AS (SELECT *, delta / se AS stat, -abs(delta / se) AS down FROM lr), pv AS (SELECT *, 2 * {phi_sql("down")} AS pvalue FROM z) --- SELECT symbol, delta, se, stat, pvalue, pvalue < 0.05 AS reject FROM pv"""


@query("sharpe_difference_naive", _sharpe_difference_sql("0"), "delta se stat pvalue")
def _(spark, d):
    return B.sharpe_difference_tests(_return_pairs(spark, d), 0)


@query("sharpe_difference_hac", _sharpe_difference_sql("ceil(round(pow(count(*), 1e0 / 3), 12))"), "delta se stat pvalue")
def _(spark, d):
    return B.sharpe_difference_tests(_return_pairs(spark, d))


_MOM = "m AS (SELECT symbol, count(*)::DOUBLE AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM {returns} GROUP BY 1), k AS (SELECT r.symbol, m.n, m.mu / m.sd AS sr, avg(pow((r.x - m.mu) / m.sd, 3)) AS sk, avg(pow((r.x - m.mu) / m.sd, 4)) AS ku FROM {returns} r JOIN m USING (symbol) GROUP BY ALL)"


def _moments(spark, d):
    return returns(spark, d).groupBy("symbol").agg(F.count("x").cast("double").alias("n"), (F.avg("x") / F.stddev_pop("x")).alias("sr"), F.skewness("x").alias("sk"), (F.kurtosis("x") + 3).alias("ku"))


# a statistic is a column of its own before the normal distribution takes it, which names it often
@query("psr", f"WITH {_MOM}, z AS (SELECT symbol, {B.psr_z_sql('sr', '5e-2', 'n', 'sk', 'ku')} AS z FROM k) --- SELECT symbol, coalesce({phi_sql('z')}, 0e0) AS psr FROM z", "psr")
def _(spark, d):
    z = _moments(spark, d).select("symbol", F.expr(B.psr_z_sql("sr", "5e-2", "n", "sk", "ku")).alias("z"))
    return z.select("symbol", F.coalesce(phi("z"), F.lit(0.0)).alias("psr"))


@query("type1_error", f"WITH {_MOM}, z AS (SELECT symbol, -1e0 * {B.psr_z_sql('sr', '0e0', 'n', 'sk', 'ku')} AS z FROM k) --- SELECT symbol, 1 - pow(1 - {phi_sql('z')}, 10) AS alpha FROM z", "alpha")
def _(spark, d):
    z = _moments(spark, d).select("symbol", (-1.0 * F.expr(B.psr_z_sql("sr", "0e0", "n", "sk", "ku"))).alias("z"))
    return z.select("symbol", (1 - F.pow(1 - phi("z"), 10)).alias("alpha"))


_THETA = "1e0 * sqrt(n - 1e0) / sqrt(" + B.sharpe_denominator_sql("sr", "sk", "ku") + ")"


@query("type2_error", f"WITH {_MOM}, q AS (SELECT symbol, pow(1e0 - 2e-1, 1e-1) AS q, {_THETA} AS theta FROM k), z AS (SELECT symbol, {phi_inv_sql('q')} - theta AS z FROM q) --- SELECT symbol, {phi_sql('z')} AS beta FROM z", "beta")
def _(spark, d):
    q = _moments(spark, d).select("symbol", F.expr("pow(1e0 - 2e-1, 1e-1)").alias("q"), F.expr(_THETA).alias("theta"))
    return q.select("symbol", (phi_inv("q") - F.col("theta")).alias("z")).select("symbol", phi("z").alias("beta"))


_FAIL = """WITH s AS (SELECT symbol, avg(x) FILTER (x > 0) AS u, abs(avg(x) FILTER (x <= 0)) AS l, avg((x > 0)::INTEGER::DOUBLE) AS p, count(*)::DOUBLE AS n FROM {returns} GROUP BY 1),
  q AS (SELECT *, (30 + 0.25) * (u - l) * (u - l) AS a, (2 * 30 * l - 0.25 * (u - l)) * (u - l) AS b, 30 * l * l AS c FROM s), z AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 THEN (sqrt(b * b - 4 * a * c) - b) / (2 * a) END AS need FROM q),
  v AS (SELECT symbol, need, (p - need) / sqrt(p * (1 - p) / n) AS score FROM z) --- """


@query("failure_probability", _FAIL + f"SELECT symbol, CASE WHEN need IS NULL THEN 1e0 ELSE {phi_sql('score')} END AS failure FROM v", "failure")
def _(spark, d):
    return B.failure_columns(returns(spark, d), 30.0, 0.5)


def _bets(spark, d):
    """Signals that open on every row of a daily series and close two days later, every third staying open."""
    p = positions(spark, d)
    return p.select("symbol", F.col("pos").cast("double").alias("start"), F.when(F.col("pos") % 3 != 0, F.col("pos") + 2.0).alias("end"), (0.5 + (F.col("pos") % 5) / 20.0).alias("probability"), F.when(F.col("pos") % 4 == 0, -1.0).otherwise(1.0).alias("prediction"))


_BETS = "bets AS (SELECT symbol, pos::DOUBLE AS start, CASE WHEN pos % 3 <> 0 THEN pos + 2e0 END AS fin, 0.5e0 + (pos % 5) / 20e0 AS probability, CASE WHEN pos % 4 = 0 THEN -1e0 ELSE 1e0 END AS prediction FROM {pos})"


@query("bet_probability", f"WITH {_BETS} --- SELECT symbol, start, prediction * (2 * {phi_sql('probability')} - 1) AS size FROM bets", "size")
def _(spark, d):
    return _bets(spark, d).select("symbol", "start", B.probability_bet_size("probability", "prediction").alias("size"))


@query("avg_bet_size", f"WITH {_BETS} --- SELECT d.symbol, d.pos::DOUBLE AS at, coalesce(avg(b.probability * b.prediction), 0) AS size FROM {{pos}} d LEFT JOIN bets b ON b.symbol = d.symbol AND b.fin IS NOT NULL AND b.start <= d.pos AND b.fin >= d.pos GROUP BY 1, 2", "size")
def _(spark, d):
    b = _bets(spark, d).filter("`end` IS NOT NULL").withColumn("size", F.col("probability") * F.col("prediction"))
    return B.concurrent_average(positions(spark, d).select("symbol", F.col("pos").cast("double").alias("at")), b)


_ACTIVE = _BETS + ", s AS (SELECT *, {signal} AS signal FROM bets), t AS (SELECT symbol, start AS at FROM s UNION SELECT symbol, fin FROM s WHERE fin IS NOT NULL), av AS (SELECT t.symbol, t.at, coalesce(avg(s.signal), 0) AS signal FROM t LEFT JOIN s ON s.symbol = t.symbol AND s.start <= t.at AND (s.fin IS NULL OR t.at < s.fin) GROUP BY 1, 2)"


@query("active_signals", "WITH " + _ACTIVE.replace("{signal}", "probability * prediction") + " --- SELECT * FROM av", "signal")
def _(spark, d):
    return B.active_average(_bets(spark, d).withColumn("signal", F.col("probability") * F.col("prediction")))


@query("generated_signals", "WITH " + _ACTIVE.replace(" FROM {pos})", " FROM {pos}), sc AS (SELECT *, (probability - 0.5e0) / sqrt(probability * (1 - probability)) AS z FROM bets)", 1).replace("FROM bets), t AS", "FROM sc), t AS", 1).replace("{signal}", "prediction * (2 * " + phi_sql("z") + " - 1)") + " --- SELECT av.symbol, av.at, greatest(least(round_even(signal / 0.05, 0) * 0.05, 1), -1) AS signal FROM av", "signal")
def _(spark, d):
    return B.generate_signals(_bets(spark, d), 2, 0.05)


@query("discrete_signal", f"WITH {_BETS} --- SELECT symbol, start, greatest(least(round_even((probability * prediction * 1.7) / 0.1, 0) * 0.1, 1), -1) AS signal FROM bets", "signal")
def _(spark, d):
    return _bets(spark, d).select("symbol", "start", B.discrete(F.col("probability") * F.col("prediction") * 1.7, 0.1).alias("signal"))


@query("bet_sigmoid", f"WITH {_BETS} --- SELECT symbol, start, start / sqrt(2 + start * start) AS size, trunc((100 - start) / sqrt(2 + (100 - start) * (100 - start)) * 10)::INTEGER AS target, 100 - prediction * 0.5 * sqrt(2 / (1 - 0.25)) AS price, start * start * (1 / 0.25 - 1) AS width FROM bets", "size price width")
def _(spark, d):
    x, w = F.col("start"), F.lit(2.0)
    return _bets(spark, d).select("symbol", "start", B.sigmoid_size(w, x).alias("size"), B.target_position(w, F.lit(100.0), x, F.lit(10)).alias("target"), B.inverse_price(F.lit(100.0), w, F.col("prediction") * 0.5).alias("price"), B.sigmoid_width(x, F.lit(0.5)).alias("width"))


@query("limit_price", "WITH p AS (SELECT symbol, pos, (pos % 8)::INTEGER AS target, (pos % 3)::INTEGER AS cur FROM {pos}), q AS (SELECT *, sign(target - cur)::INTEGER AS s FROM p) --- SELECT symbol, pos, CASE WHEN target = cur THEN 100e0 ELSE coalesce((SELECT sum(100 - (i / 10e0) * sqrt(2 / (1 - (i / 10e0) * (i / 10e0)))) FROM range(abs(cur + s), abs(target + s)) r(i)), 0) / abs(target - cur) END AS price FROM q", "price")
def _(spark, d):
    p = positions(spark, d).select("symbol", F.col("pos").cast("long").alias("pos"), (F.col("pos") % 8).cast("int").alias("target"), (F.col("pos") % 3).cast("int").alias("cur"))
    return p.select("symbol", "pos", B.limit_price(F.col("target"), F.col("cur"), F.lit(100.0), F.lit(2.0), F.lit(10.0)).alias("price"))


_SIDES = f"WITH {_BETS}, pt AS (SELECT symbol, start AS at FROM bets UNION SELECT symbol, fin FROM bets WHERE fin IS NOT NULL) --- SELECT a.symbol, a.at, sum((prediction > 0)::INTEGER)::DOUBLE AS long, sum((prediction < 0)::INTEGER)::DOUBLE AS short FROM pt a JOIN bets b ON a.symbol = b.symbol AND b.start <= a.at AND (b.fin IS NULL OR a.at < b.fin) GROUP BY 1, 2"


@query("concurrent_sides", _SIDES)
def _(spark, d):
    return B.concurrent_sides(_bets(spark, d).withColumn("signal", F.col("prediction")))


@query("gaussian_bet", f"WITH {_BETS}, c AS (SELECT symbol, start, probability * prediction * 4 AS x FROM bets), m AS (SELECT *, 0.6 * {phi_sql('(x - 1e0) / 2e0')} + 0.4 * {phi_sql('(x + 1e0) / 1e0')} AS f, 0.6 * {phi_sql('-1e0 / 2e0')} + 0.4 * {phi_sql('1e0')} AS z FROM c) --- SELECT symbol, start, CASE WHEN x >= 0 THEN (f - z) / (1 - z) ELSE (f - z) / z END AS size FROM m", "size")
def _(spark, d):
    return _bets(spark, d).select("symbol", "start", (F.col("probability") * F.col("prediction") * 4).alias("x")).select("symbol", "start", B.gaussian_bet("x", 1.0, 2.0, -1.0, 1.0, 0.6).alias("size"))


def _tests(spark, d):
    return returns(spark, d).groupBy(F.col("symbol").alias("strategy")).agg(B.sharpe("x").alias("s0")).select(F.lit("all").alias("symbol"), "strategy", (F.abs("s0") + 0.1).alias("sr"))


_TEST = f"t AS (SELECT symbol AS strategy, abs(avg(x) / stddev_pop(x)) + 0.1e0 AS sr FROM {{returns}} GROUP BY 1), p AS (SELECT *, {phi_sql('-sr * sqrt(60e0)')} AS p FROM t), h AS (SELECT *, row_number() OVER (ORDER BY p, strategy) AS k, count(*) OVER () AS m FROM p)"
_HAIR = " SELECT 'all' AS symbol, strategy, sr, p, adjusted, " + phi_inv_sql("(1e0 - greatest(least(adjusted, 1e0 - 1e-15), 1e-15))") + " / sqrt(60e0) AS haircut, adjusted <= 0.05 AS significant FROM a"


@query("haircut_holm", f"WITH {_TEST}, a AS (SELECT strategy, sr, p, least(max((m - k + 1) * p) OVER (ORDER BY k), 1e0) AS adjusted FROM h) ---" + _HAIR, "sr p adjusted haircut")
def _(spark, d):
    return B.haircut_sharpe(_tests(spark, d), 60.0, "holm")


@query("haircut_bhy", f"WITH {_TEST}, c AS (SELECT sum(1e0 / i) AS c FROM h, range(1, 100) r(i) WHERE h.k = 1 AND i <= h.m), a AS (SELECT strategy, sr, p, least(min(c * m * p / k) OVER (ORDER BY k DESC), 1e0) AS adjusted FROM h, c) ---" + _HAIR, "sr p adjusted haircut")
def _(spark, d):
    return B.haircut_sharpe(_tests(spark, d), 60.0, "bhy")


@query("max_sharpe_simulated")
def _(spark, d):
    return B.mean_std_error(spark, 50, 5, [5, 10, 20])


@query("ou_fit", "WITH l AS (SELECT symbol, x, lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS x0 FROM {returns}), g AS (SELECT symbol, regr_slope(x, x0) AS b0, regr_intercept(x, x0) AS a, regr_syy(x, x0) AS syy, regr_sxy(x, x0) AS sxy, count(*) AS n FROM l WHERE x0 IS NOT NULL GROUP BY 1), r AS (SELECT *, greatest(least(b0, 0.999999), 1e-6) AS rho FROM g), t AS (SELECT *, -ln(rho) AS theta, syy - b0 * sxy AS rss FROM r), s AS (SELECT *, sqrt(rss / (n - 2) * 2 * theta / (1 - rho * rho)) AS sigma FROM t) --- SELECT symbol, theta, sigma, a / (1 - rho) AS mu, rho, ln(2) / theta AS half_life, sigma / sqrt(2 * theta) AS stationary_std, 1 - rss / syy AS r2 FROM s", "theta sigma mu rho half_life stationary_std r2")
def _(spark, d):
    return ou.fit_process(returns(spark, d))


@query("ou_rule_grid")
def _(spark, d):
    return ou.metrics_grid(spark, [0.5, 1.0, 2.0], [0.5, 1.0, 2.0], 0.1, 0.3, 1.0)


@query("synthetic_backtest")
def _(spark, d):
    return ou.synthetic_backtest(spark, 0.0, 5.0, 1.0, [1.0, 2.0], [1.0, 2.0], 2000, 20)


# ---- validation ------------------------------------------------------------------------------------

_FOLD = "SELECT symbol, pos, ntile({k}) OVER (PARTITION BY symbol ORDER BY pos) AS fold FROM {{pos}}"


def _split(df):
    return df.select("symbol", F.col("split_id").cast("int").alias("split_id"), F.col("pos").cast("long").alias("pos"), "role")


@query("kfold_splits", f"SELECT symbol, s::INTEGER AS split_id, pos, CASE WHEN fold = s THEN 'test' ELSE 'train' END AS role FROM ({_FOLD.format(k=5)}), range(1, 6) r(s)")
def _(spark, d):
    return _split(V.k_fold(positions(spark, d), 5))


@query("walk_forward", f"WITH f AS ({_FOLD.format(k=5)}), s AS (SELECT symbol, fold AS split_id, min(pos) AS first FROM f GROUP BY 1, 2) --- SELECT f.symbol, s.split_id::INTEGER AS split_id, pos, CASE WHEN fold = split_id THEN 'test' ELSE 'train' END AS role FROM f JOIN s USING (symbol) WHERE fold = split_id OR (pos <= first - 2 AND pos > first - 12)")
def _(spark, d):
    return _split(V.walk_forward(positions(spark, d), 5, 1, 10))


@query("purged_kfold", f"WITH f AS ({_FOLD.format(k=5)}), t AS (SELECT f.symbol, fold AS s, i.pos, start, \"end\" AS fin FROM f JOIN {{info}} i USING (symbol, pos)), b AS (SELECT symbol, s, min(start) AS lo, max_by(fin, start) AS hi, max(n) AS n, any_value(st) AS st FROM t JOIN (SELECT symbol, count(*) AS n, list(pos ORDER BY pos) AS st FROM {{pos}} GROUP BY 1) USING (symbol) GROUP BY 1, 2), c AS (SELECT symbol, s, lo, CASE WHEN len(list_filter(st, lambda x: x < hi)) < n THEN st[least(len(list_filter(st, lambda x: x < hi)) + floor(n * 0.05)::BIGINT, n - 1) + 1] ELSE hi END AS hi FROM b) --- SELECT symbol, s::INTEGER AS split_id, pos, 'test' AS role FROM t UNION ALL SELECT c.symbol, c.s::INTEGER, t.pos, 'train' FROM c JOIN t USING (symbol) WHERE NOT (start <= hi AND fin >= lo) AND t.s <> c.s")
def _(spark, d):
    return _split(V.purged_k_fold(info(spark, d), 5, 0.05))


@query("cpcv_splits", f"WITH f AS ({_FOLD.format(k=6)}), c AS (SELECT row_number() OVER (ORDER BY a, b) AS s, a, b FROM range(1, 7) x(a), range(1, 7) y(b) WHERE a < b), t AS (SELECT symbol, s, pos FROM f JOIN c ON fold IN (a, b)) --- SELECT symbol, s::INTEGER AS split_id, pos, 'test' AS role FROM t UNION ALL SELECT p.symbol, c.s::INTEGER, p.pos, 'train' FROM {{pos}} p, c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.symbol = p.symbol AND t.s = c.s AND abs(t.pos - p.pos) <= 2)")
def _(spark, d):
    return _split(V.combinatorial_purged(info(spark, d), 6, 2))


@query("backtest_paths", f"WITH f AS ({_FOLD.format(k=6)}), c AS (SELECT row_number() OVER (ORDER BY a, b) AS s, a, b FROM range(1, 7) x(a), range(1, 7) y(b) WHERE a < b), u AS (SELECT s, a AS fold FROM c UNION ALL SELECT s, b FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY s) AS path_id FROM u) --- SELECT symbol, path_id::INTEGER AS path_id, fold::INTEGER AS fold, s::INTEGER AS split_id, pos FROM f JOIN q USING (fold)")
def _(spark, d):
    return V.backtest_paths(positions(spark, d), 6, 2).select("symbol", "path_id", F.col("fold").cast("int").alias("fold"), "split_id", F.col("pos").cast("long").alias("pos"))


_PBO = """WITH h AS (SELECT t, ntile(4) OVER (ORDER BY t) AS part FROM (SELECT DISTINCT t FROM {perf})), c AS (SELECT row_number() OVER (ORDER BY a, b) AS s, a, b FROM range(1, 5) x(a), range(1, 5) y(b) WHERE a < b),
  m AS (SELECT s, part IN (a, b) AS tr, strategy, avg(x) / stddev_pop(x) AS m FROM {perf} JOIN h USING (t), c GROUP BY ALL), best AS (SELECT s, arg_max(strategy, (m, -strategy)) AS strategy FROM m WHERE tr GROUP BY 1),
  k AS (SELECT s, strategy, row_number() OVER (PARTITION BY s ORDER BY m, strategy) / (count(*) OVER (PARTITION BY s) + 1e0) AS w FROM m WHERE NOT tr), pb AS (SELECT s::INTEGER AS split_id, ln(w / (1 - w)) AS logit, ln(w / (1 - w)) <= 0 AS overfit FROM k JOIN best USING (s, strategy))"""


@query("pbo_logits", _PBO + " --- SELECT * FROM pb", "logit")
def _(spark, d):
    return V.pbo_logits(S.performances(spark, d), 4)


@query("pbo", _PBO + " --- SELECT avg(overfit::INTEGER::DOUBLE) AS pbo FROM pb", "pbo")
def _(spark, d):
    return V.probability_of_overfitting(S.performances(spark, d), 4)


_REG = "g AS (SELECT t, stddev_pop(x) AS d FROM {perf} GROUP BY 1), s AS (SELECT t, avg(d) OVER (ORDER BY t ROWS 2 PRECEDING) AS smooth FROM g), rg AS (SELECT t, smooth, (smooth > (SELECT quantile_cont(smooth, 0.5) FROM s))::INTEGER AS regime FROM s)"


@query("vol_regimes", f"WITH {_REG} --- SELECT * FROM rg", "smooth")
def _(spark, d):
    return V.volatility_regimes(S.performances(spark, d))


@query("adaptive_pbo", _PBO + f", {_REG}, nn AS (SELECT count(*) AS n FROM rg), fw AS (SELECT regime, count(*) AS c FROM (SELECT *, row_number() OVER (ORDER BY t) AS k FROM rg), nn WHERE k > floor(0.75 * n) GROUP BY 1), lb AS (SELECT arg_max(regime, (c, -regime)) AS lab FROM fw), wt AS (SELECT c.s, avg((regime = lab)::INTEGER::DOUBLE) + 1e-3 AS w FROM rg JOIN h USING (t), c, lb WHERE part NOT IN (a, b) GROUP BY 1) --- SELECT sum(w * overfit::INTEGER::DOUBLE) / sum(w) AS pbo FROM pb JOIN wt ON wt.s = pb.split_id", "pbo")
def _(spark, d):
    return V.adaptive_overfitting(S.performances(spark, d), 4)[0]


def _perf_matrix(spark, d) -> np.ndarray:
    """30 days by 5 strategies on the driver: the size is fixed by the calendar."""
    p = S.performances(spark, d).toPandas()
    return p.pivot(index="t", columns="strategy", values="x").fillna(0.0).to_numpy()


_MOMENTS = "WITH c AS (SELECT symbol, x, x - avg(x) OVER (PARTITION BY symbol) AS d FROM {returns}), g AS (SELECT symbol, count(*)::DOUBLE AS n, avg(x) / sqrt(avg(d * d)) AS observed_sharpe, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) AS kurt FROM c GROUP BY 1)"


@query("deflated_sharpe_gate", _MOMENTS + f", b AS (SELECT *, {float(B.expected_max(10, 0.0, 0.2))!r}::DOUBLE AS benchmark_sharpe FROM g), p AS (SELECT *, {B.psr_sql('observed_sharpe', 'benchmark_sharpe', 'n', 'skew', 'kurt')} AS deflated_sharpe FROM b) --- SELECT symbol, observed_sharpe, benchmark_sharpe, 10::BIGINT AS n_trials, deflated_sharpe, deflated_sharpe > 0.5 AS passes FROM p", "observed_sharpe benchmark_sharpe deflated_sharpe")
def _(spark, d):
    return V.deflated_sharpe_gates(returns(spark, d), 10, 0.2)


@query("benchmark_sharpe_ratio", _MOMENTS + f", s AS (SELECT count(*)::DOUBLE AS n, stddev_pop(observed_sharpe) AS sd FROM g) --- SELECT sd * ({1 - EULER!r} * {phi_inv_sql('1e0 - 1e0 / n')} + {EULER!r} * {phi_inv_sql(f'1e0 - 1e0 / (n * {math.e!r})')}) AS benchmark FROM s", "benchmark")
def _(spark, d):
    return B.benchmark_sharpes(returns(spark, d).groupBy("symbol").agg(B.sharpe("x").alias("sr")))


#: Twenty bags of wrapped blocks of five times, whose starts are hashes.
_BAGGED = """WITH tm AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS row FROM (SELECT DISTINCT t FROM {perf})), nt AS (SELECT count(*) AS n FROM tm),
  dr AS (SELECT bag, b * 5 + k AS pos, (('0x' || substr(md5('0:' || bag || ':' || b), 1, 15))::BIGINT % n + k) % n AS row, n FROM nt, range(20) x(bag), range((n + 4) // 5) y(b), range(5) z(k) WHERE b * 5 + k < n),
  fo AS (SELECT bag, row, ntile(4) OVER (PARTITION BY bag ORDER BY pos) AS part FROM dr),
  c AS (SELECT row_number() OVER (ORDER BY a, b) AS s, a, b FROM range(1, 5) x(a), range(1, 5) y(b) WHERE a < b),
  m AS (SELECT bag, s, part IN (a, b) AS tr, strategy, CASE WHEN stddev_pop(x) < 1e-14 THEN 0 ELSE avg(x) / stddev_pop(x) END AS m FROM fo JOIN tm USING (row) JOIN {perf} USING (t), c GROUP BY ALL),
  best AS (SELECT bag, s, arg_max(strategy, (m, -strategy)) AS strategy FROM m WHERE tr GROUP BY 1, 2),
  k AS (SELECT bag, s, strategy, row_number() OVER (PARTITION BY bag, s ORDER BY m, strategy) / (count(*) OVER (PARTITION BY bag, s) + 1e0) AS w FROM m WHERE NOT tr)
  --- SELECT bag, avg((w <= 0.5)::INTEGER::DOUBLE) AS pbo FROM k JOIN best USING (bag, s, strategy) GROUP BY 1"""


@query("bagged_pbo", _BAGGED, "pbo")
def _(spark, d):
    return V.bagged_overfitting(S.performances(spark, d), 4, 20)


# ---- matrices --------------------------------------------------------------------------------------

DIMS = 64


def _cov(spark, d):
    return matrix.covariance(table(spark, d, "embeddings").select(F.transform(F.slice("embedding", 1, DIMS), lambda x: x.cast("double")).alias("v")), "v", DIMS)


_COV = f"e AS (SELECT vec_id, unnest(range(1, {DIMS + 1}))::INTEGER AS i, unnest(embedding[1:{DIMS}])::DOUBLE AS x FROM embeddings), cv AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2), dg AS (SELECT i, sqrt(v) AS s FROM cv WHERE i = j), cr AS (SELECT cv.i, cv.j, CASE WHEN cv.i = cv.j THEN 1e0 ELSE greatest(least(v / (a.s * b.s), 1), -1) END AS v FROM cv JOIN dg a ON a.i = cv.i JOIN dg b ON b.i = cv.j)"


@query("cov_matrix", f"WITH {_COV} --- SELECT * FROM cv", "v", 8)
def _(spark, d):
    return _cov(spark, d)


@query("corr_matrix", f"WITH {_COV} --- SELECT * FROM cr", "v")
def _(spark, d):
    return matrix.correlation(_cov(spark, d))


@query("corr_distance", f"WITH {_COV} --- SELECT i, j, sqrt(round_even((1 - v) * 1e6, 0) / 1e6 / 2) AS v FROM cr", "v", 5)
def _(spark, d):
    c = matrix.correlation(_cov(spark, d))
    return c.select("i", "j", dependence.correlation_distance(F.col("v")).alias("v"))


@query("inverse_variance", f"WITH {_COV} --- SELECT i AS asset, (1 / v) / sum(1 / v) OVER () AS weight FROM cv WHERE i = j", "weight")
def _(spark, d):
    return matrix.inverse_variance(_cov(spark, d))


@query("silhouette", f"WITH {_COV}, ds AS (SELECT i, j, sqrt(greatest(1 - v, 0) / 2) AS v FROM cr), m AS (SELECT i, i % 3 AS ci, j % 3 AS cj, avg(v) AS d FROM ds WHERE i <> j GROUP BY 1, 2, 3), q AS (SELECT i, max(CASE WHEN ci = cj THEN d END) AS a, min(CASE WHEN ci <> cj THEN d END) AS b FROM m GROUP BY 1) --- SELECT i AS item, (b - a) / greatest(a, b) AS silhouette FROM q", "silhouette")
def _(spark, d):
    c = matrix.correlation(_cov(spark, d)).withColumn("v", F.sqrt(F.greatest(1 - F.col("v"), F.lit(0.0)) / 2))
    return matrix.silhouette(c, spark.range(1, DIMS + 1).select(F.col("id").cast("int").alias("item"), (F.col("id") % 3).alias("cluster")))


@query("block_matrix", "SELECT i, j, CASE WHEN i = j THEN 1e0 WHEN (i - 1) // 3 = (j - 1) // 3 THEN 0.5e0 ELSE 0e0 END AS v FROM range(1, 13) a(i), range(1, 13) b(j)")
def _(spark, d):
    return matrix.block_matrix(spark, 4, 3, 0.5)


@query("marcenko_pastur", f"SELECT range AS id, {0.5 * (1 - 10**-0.5) ** 2!r} + {0.5 * (1 + 10**-0.5) ** 2 - 0.5 * (1 - 10**-0.5) ** 2!r} * range / 99e0 AS x, 10 / (2 * pi() * 0.5 * ({0.5 * (1 - 10**-0.5) ** 2!r} + {0.5 * (1 + 10**-0.5) ** 2 - 0.5 * (1 - 10**-0.5) ** 2!r} * range / 99e0)) * sqrt(greatest(({0.5 * (1 + 10**-0.5) ** 2 - 0.5 * (1 - 10**-0.5) ** 2!r} - {0.5 * (1 + 10**-0.5) ** 2 - 0.5 * (1 - 10**-0.5) ** 2!r} * range / 99e0) * ({0.5 * (1 + 10**-0.5) ** 2 - 0.5 * (1 - 10**-0.5) ** 2!r} * range / 99e0), 0)) AS pdf FROM range(100)", "x pdf", 5)
def _(spark, d):
    return matrix.marcenko_pastur_rows(spark, 0.5, 10, 100)


@query("drift_burst", "WITH s AS (SELECT range AS id, range / 100e0 AS s, CASE WHEN abs(range / 100e0 - 0.5) <= 0.1 THEN 0.1 ELSE abs(range / 100e0 - 0.5) END AS g FROM range(101)) --- SELECT id, CASE WHEN id = 50 THEN 0 WHEN id < 50 THEN 1 / sqrt(g) ELSE 2 / sqrt(g) END AS drift, CASE WHEN id <= 50 THEN 0.5 / sqrt(g) ELSE 1 / sqrt(g) END AS volatility FROM s", "drift volatility")
def _(spark, d):
    return synthetic.burst(spark, 101, (1.0, 2.0), (0.5, 1.0), 0.5, 0.5)


def _driver_cov(spark, d) -> np.ndarray:
    return matrix.to_numpy(_cov(spark, d), DIMS)


def _weights(spark, w) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"asset": np.arange(1, len(w) + 1), "weight": np.asarray(w, float)}))


@query("denoised_cov")
def _(spark, d):
    return matrix.from_numpy(spark, matrix.denoise_cov(_driver_cov(spark, d), 10.0))


@query("nercome_cov")
def _(spark, d):
    return matrix.nercome_rows(spark, _perf_matrix(spark, d), 20)


def _eliminated(rows: str) -> str:
    """CTE s whose last row has the covariances, each row with more columns after it, reduced to the unit matrix."""
    return f"""WITH RECURSIVE {_COV}, mx AS (SELECT list({rows} ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS r FROM cv GROUP BY i)),
  s AS (SELECT 1 AS k, a FROM mx UNION ALL SELECT k + 1, list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(a[k], lambda v: v / a[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] / a[k][k] * a[k][j]) END) FROM s WHERE k <= {DIMS})"""


_SOLVED = _eliminated("list_append(r, 1e0)") + f" --- SELECT asset, w / sum(w) OVER () AS weight FROM (SELECT unnest(range(1, {DIMS + 1})) AS asset, unnest(list_transform(a, lambda r: r[-1])) AS w FROM s WHERE k = {DIMS + 1})"


@query("optimal_portfolio", _SOLVED, "weight")
def _(spark, d):
    return _weights(spark, matrix.optimal_portfolio(_driver_cov(spark, d)))


#: The spanning tree grown from the first item, by its least edge in each step.
_TREE = f"WITH RECURSIVE {_COV}, ed AS (SELECT i, j, sqrt(greatest((1 - v) / 2, 0)) AS v FROM cr WHERE i <> j), p AS (SELECT [1] AS seen, NULL::STRUCT(v DOUBLE, i INTEGER, j INTEGER) AS e UNION ALL SELECT list_append(seen, CASE WHEN list_contains(seen, e.i) THEN e.j ELSE e.i END), e FROM (SELECT p.seen, min({{'v': ed.v, 'i': least(ed.i, ed.j), 'j': greatest(ed.i, ed.j)}}) AS e FROM p JOIN ed ON list_contains(p.seen, ed.i) AND NOT list_contains(p.seen, ed.j) GROUP BY p.seen)) --- SELECT e.i, e.j, e.v FROM p WHERE e IS NOT NULL"


@query("asset_tree", _TREE, "v")
def _(spark, d):
    return spark.createDataFrame([(i, j, v) for v, i, j in matrix.spanning_tree(matrix.distances(_cov(spark, d)))], "i int, j int, v double")


#: Leaves joined along the tree's edges, shortest first, the cluster of the lesser number in front; then halves of that
#: order share weight by the variances of their inverse-variance portfolios.
_PARITY = _TREE.split(" --- ")[0] + f""",
  te AS (SELECT e.i AS i, e.j AS j, row_number() OVER (ORDER BY e.v, e.i, e.j) AS k FROM p WHERE e IS NOT NULL),
  mg AS (SELECT 1 AS k, list_transform(range(1, {DIMS + 1}), lambda x: {{'no': x, 'leaves': [x::INTEGER]}}) AS parts UNION ALL
    SELECT k + 1, list_append(list_filter(parts, lambda q: q.no <> a.no AND q.no <> b.no), CASE WHEN a.no < b.no THEN {{'no': {DIMS} + k, 'leaves': list_concat(a.leaves, b.leaves)}} ELSE {{'no': {DIMS} + k, 'leaves': list_concat(b.leaves, a.leaves)}} END)
    FROM (SELECT mg.k, parts, list_filter(parts, lambda q: list_contains(q.leaves, te.i))[1] AS a, list_filter(parts, lambda q: list_contains(q.leaves, te.j))[1] AS b FROM mg JOIN te ON te.k = mg.k)),
  lv AS (SELECT unnest(parts[1].leaves) AS asset, unnest(range(0, {DIMS})) AS place FROM mg WHERE k = {DIMS}),
  sp AS (SELECT 0 AS lo, {DIMS} AS hi, 0 AS parent, 0 AS side UNION ALL SELECT CASE WHEN h.side = 0 THEN lo ELSE mid END, CASE WHEN h.side = 0 THEN mid ELSE hi END, lo * 1000 + hi, h.side + 1 FROM (SELECT *, lo + (hi - lo) // 2 AS mid FROM sp WHERE hi - lo > 1), (VALUES (0), (1)) h(side)),
  iv AS (SELECT lo, hi, parent, lv.asset, (1 / cv.v) / sum(1 / cv.v) OVER (PARTITION BY lo, hi) AS w FROM sp JOIN lv ON place >= lo AND place < hi JOIN cv ON cv.i = lv.asset AND cv.j = lv.asset WHERE side > 0),
  cl AS (SELECT a.lo, a.hi, any_value(a.parent) AS parent, sum(a.w * b.w * cv.v) AS var FROM iv a JOIN iv b ON a.lo = b.lo AND a.hi = b.hi JOIN cv ON cv.i = a.asset AND cv.j = b.asset GROUP BY 1, 2),
  sh AS (SELECT lo, hi, 1 - var / sum(var) OVER (PARTITION BY parent) AS share FROM cl)
  --- SELECT lv.asset::BIGINT AS asset, product(share) AS weight FROM lv JOIN sh ON place >= lo AND place < hi GROUP BY 1"""


@query("hrp_weights", _PARITY, "weight")
def _(spark, d):
    return _weights(spark, matrix.hierarchical_weights(_cov(spark, d), DIMS))


def _orthogonal(spark, d, threshold):
    return matrix.orthogonal_rows(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", DIMS, threshold)


_STANDARD = f"z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS z FROM (SELECT vec_id, unnest(range(1, {DIMS + 1})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings))"


@query("orthogonal_features", f"WITH {_STANDARD} --- SELECT vec_id, sum(z * z) AS squares FROM z GROUP BY 1", "squares")
def _(spark, d):
    """All components: a rotation keeps each row's squares."""
    return _orthogonal(spark, d, 1.0).select("vec_id", F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x).alias("squares"))


@query("orthogonal_gram", f"WITH n AS (SELECT unnest(range(1, {DIMS + 1}))::INTEGER AS i) --- SELECT a.i, b.i AS j, 0e0 AS v FROM n a JOIN n b ON a.i < b.i")
def _(spark, d):
    """The components' covariances with each other, all of which are nought."""
    return matrix.covariance(_orthogonal(spark, d, 1.0), "components", DIMS).filter("i < j").select("i", "j", "v")


_TAU = f"""WITH e AS (SELECT label, unnest(range(1, {DIMS + 1})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), o AS (SELECT i, avg(x) AS m, row_number() OVER (ORDER BY stddev_samp(x) DESC, i) AS rk FROM e GROUP BY i),
  t AS (SELECT e.label, e.i, abs(avg(e.x) - any_value(o.m)) AS x, any_value(1e0 / o.rk) AS y FROM e JOIN o USING (i) GROUP BY 1, 2),
  r AS (SELECT *, 1e0 / row_number() OVER (PARTITION BY label ORDER BY x DESC) AS wx, 1e0 / row_number() OVER (PARTITION BY label ORDER BY y DESC) AS wy FROM t),
  q AS (SELECT a.label, sum((a.wx + b.wx) * sign(a.x - b.x) * sign(a.y - b.y)) / sum(a.wx + b.wx) AS tx, sum((a.wy + b.wy) * sign(a.x - b.x) * sign(a.y - b.y)) / sum(a.wy + b.wy) AS ty FROM r a JOIN r b ON a.label = b.label AND a.i < b.i GROUP BY 1) --- SELECT label, (tx + ty) / 2 AS tau FROM q"""


@query("weighted_tau", _TAU, "tau")
def _(spark, d):
    """How far the features that set a label apart are those of large deviation."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    rank = F.row_number().over(Window.orderBy(F.desc("sd"), "i"))  # as many rows as an embedding has values
    overall = e.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).withColumn("rank", rank)
    scores = e.groupBy("label", "i").agg(F.avg("x").alias("own")).join(overall, "i").select("label", F.abs(F.col("own") - F.col("m")).alias("importance"), "rank")
    return importance.weighted_taus(scores, "importance", "rank", "label")


@query("nco_weights")
def _(spark, d):
    return _weights(spark, matrix.nested_clustered(_driver_cov(spark, d), clusters=4))


@query("onc_clusters")
def _(spark, d):
    labels_, s = matrix.optimal_clusters(matrix.cov_to_corr(_driver_cov(spark, d)), 6, 3)
    return spark.createDataFrame(pd.DataFrame({"item": np.arange(1, DIMS + 1), "cluster": labels_, "silhouette": s}))


#: The inverse squared over and over leaves the last component alone; its greatest entry is positive.
_LAST_COMPONENT = (
    _eliminated(f"list_concat(r, list_transform(range(1, {DIMS + 1}), lambda j: (i = j)::INTEGER::DOUBLE))")
    + f""",
  pw AS (SELECT 0 AS k, list_transform(a, lambda r: r[{DIMS + 1}:]) AS m FROM s WHERE k = {DIMS + 1} UNION ALL
    SELECT k + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / t)) FROM (SELECT k, m, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS t FROM pw WHERE k < 24)),
  fl AS (SELECT unnest(range(1, {DIMS + 1})) AS asset, unnest(m[list_position(list_transform(m, lambda r, i: r[i]), list_max(list_transform(m, lambda r, i: r[i])))]) AS v FROM pw WHERE k = 24)
  --- SELECT f.asset, f.v / sqrt(any_value(q.risk)) AS weight FROM fl f, (SELECT sum(a.v * b.v * cv.v) AS risk FROM fl a JOIN cv ON cv.i = a.asset JOIN fl b ON cv.j = b.asset) q GROUP BY f.asset, f.v"""
)


@query("pca_hedge", _LAST_COMPONENT, "weight")
def _(spark, d):
    w = matrix.pca_weights(_driver_cov(spark, d))
    return _weights(spark, w * np.sign(w[np.abs(w).argmax()]))


@query("hrp_monte_carlo")
def _(spark, d):
    return matrix.hrp_monte_carlo(spark, 16)


@query("simulated_prices")
def _(spark, d):
    calm = dict(mu=0.1, kappa=2.0, theta=0.04, xi=0.2, rho=-0.5, lam=0.5, m=0.0, v=0.02)
    return synthetic.simulate_prices(spark, 4, {"calm": calm, "wild": calm | {"theta": 0.16}}, [[0.95, 0.05], [0.1, 0.9]], 1.0, 50)


# ---- importance, ensembles, equations --------------------------------------------------------------


#: Columns of an embedding.
WIDTH = 64


def _samples(spark, d) -> DataFrame:
    """All embeddings with all their columns and labels."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("row"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("int").alias("y"))


def _two(spark, d) -> DataFrame:
    """The same with the labels' parity."""
    return _samples(spark, d).withColumn("y", F.col("y") % 2)


@query("importance_mdi")
def _(spark, d):
    return importance.mean_decrease_impurity(_samples(spark, d), WIDTH, trees=20)


@query("importance_clustered_mdi")
def _(spark, d):
    c = spark.range(WIDTH).select(F.col("id").cast("int").alias("feature"), (F.col("id") % 8).cast("int").alias("cluster"))
    return importance.clustered_impurity(importance.mean_decrease_impurity(_samples(spark, d), WIDTH, trees=20), c)


@query("importance_mda")
def _(spark, d):
    return importance.mean_decrease_accuracy(_samples(spark, d), WIDTH, k=3, trees=10)


@query("importance_clustered_mda")
def _(spark, d):
    return importance.mean_decrease_accuracy(_samples(spark, d), WIDTH, k=3, trees=10, clusters=[list(range(c, WIDTH, 8)) for c in range(8)])


@query("importance_sfi")
def _(spark, d):
    return importance.single_feature(_samples(spark, d), WIDTH, k=3, trees=5)


@query("importance_mdi_plus")
def _(spark, d):
    return importance.mdi_plus(_samples(spark, d), WIDTH, trees=20)


@query("importance_cpi")
def _(spark, d):
    return importance.predictive_impact(_samples(spark, d), WIDTH, k=3, trees=10)


@query("cv_scores")
def _(spark, d):
    rows = _samples(spark, d).withColumns({"start": F.col("row"), "end": F.col("row") + 2})
    return importance.cross_val_score(*importance.contiguous_splits(rows, 4, 0.01), trees=10)


@query("hpo_scores")
def _(spark, d):
    rows, splits = importance.with_folds(_samples(spark, d), 3)
    return importance.search(rows, importance.parameter_grid({"n_trees": [5, 10], "max_depth": [2, 4]}), splits)[1]


@query("leakage_aware_hpo")
def _(spark, d):
    rows = _samples(spark, d).withColumns({"start": F.col("row"), "end": F.col("row") + 2})
    r = importance.leakage_aware_search(rows, {"n_trees": [5, 8], "max_depth": [2, 3]}, 3, 3)
    return spark.createDataFrame([(k, s) for k, s in enumerate(r["trial_scores"])], "trial int, score double")


@query("bagging_votes")
def _(spark, d):
    return importance.bagging_votes(_two(spark, d), _two(spark, d), 50)


@query("bagging_schemes")
def _(spark, d):
    return importance.scheme_accuracy(importance.bagging_votes(_two(spark, d), _two(spark, d), 50))


@query("bagging_accuracy", "WITH n AS (SELECT unnest([3, 11, 25]) AS n), k AS (SELECT n, unnest(range(n // 2 + 1, n + 1)) AS k FROM n) --- SELECT n::BIGINT AS n, sum(exp(lgamma(n + 1e0) - lgamma(k + 1e0) - lgamma(n - k + 1e0)) * pow(0.6e0, k) * pow(0.4e0, n - k)) AS accuracy FROM k GROUP BY n", "accuracy")
def _(spark, d):
    return spark.createDataFrame([(n, importance.bagging_accuracy(n, 0.6)) for n in (3, 11, 25)], "n long, accuracy double")


@query("pde_terminal")
def _(spark, d):
    eq = pde.BorrowingRates(3, 1.0, 5)
    return pde.terminal_values(pde.sample_paths(spark, eq, 200), eq)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
