"""Streaming bars give what the batch fold gives on the same ticks; late ticks are counted aside; files that
arrive, restarts and replays add each row once."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import bars
from fathomline.schemas import BARS_DDL
from fathomline.sources import ticks as S
from fathomline.sources.ticks import ticks_from_events
from fathomline.streaming import bars as B
from fathomline.streaming import feeds

TICKS = "symbol string, ts timestamp_ntz, seq long, price double, volume double"


def ticks_of(spark, rows):
    """rows: symbol, time, seq, price, volume, and further columns."""
    more = len(rows[0]) - 5
    schema = "symbol string, ts string, seq long, price double, volume double" + "".join(f", c{k} int" for k in range(more))
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    return ticks_from_events(spark, "/root/testdata/sf0.001")


def test_stream_equals_batch(events):
    t = events.filter("symbol IN ('click', 'view')")
    rule = bars.Rule("imbalance", "tick", 0.0, 10.0, 20)
    feed = feeds.Feed(t.withColumn("part", feeds.slices_by_time("ts", ["2024-01-08", "2024-01-15", "2024-01-22"])), "part")
    got = feeds.run_feed(feed, 5, lambda s: B.stream_bars(s, rule), f"symbol string, {BARS_DDL}")
    want = rows_of(bars.fold_bars(t, rule))
    assert len(want) > 3 and rows_of(got) == want


def test_later_ticks_with_smaller_numbers_are_kept(spark):
    """Ticks of later batches count by time and then number, as in the batch fold."""
    rows = [("a", f"2024-01-0{1 + k // 4} 00:00:0{k % 4}", 100 - k, float(1 + k % 3), 1.0, k // 4) for k in range(12)]
    t = ticks_of(spark, rows)
    rule = bars.Rule("standard", "volume", 2.0)
    got = feeds.run_feed(feeds.Feed(t, "c0"), 3, lambda s: B.stream_bars(s, rule), f"symbol string, {BARS_DDL}")
    assert rows_of(got) == rows_of(bars.fold_bars(t.drop("c0"), rule))


def test_a_query_goes_on_from_its_checkpoint(spark, events, tmp_path):
    """A job that stops after each slice, or runs twice without new files, gives each bar once."""
    rule = bars.Rule("standard", "dollar", 20000.0)
    feed = feeds.Feed(events.withColumn("part", feeds.slices_by_time("ts", ["2024-01-11", "2024-01-21"])), "part")
    counts = []
    for k in (0, None, 1, 2, None):
        if k is not None:
            assert feed.arrive(k)
        feeds.advance(B.stream_bars(feed.stream(), rule), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts[0] == counts[1] < counts[2] < counts[3] == counts[4]
    assert not feed.arrive(7)
    assert rows_of(spark.read.schema(f"symbol string, {BARS_DDL}").parquet(str(tmp_path / "out"))) == rows_of(bars.fold_bars(events, rule))


def test_several_files_a_batch_and_one(spark, tmp_path):
    rows = [("ab"[k % 2], f"2024-01-01 00:{k:02d}:00", k, float(k % 7), 1.0, k // 10) for k in range(40)]
    t = ticks_of(spark, rows)
    rule = bars.Rule("standard", "volume", 3.0)
    want = rows_of(bars.fold_bars(t.drop("c0"), rule))
    for files in (None, 1):
        feed = feeds.Feed(t.repartition(1), "c0")
        for k in range(4):
            feed.arrive(k)
        # one file a batch: files were written one after another by one task, in order of their slice
        feeds.advance(B.stream_bars(feed.stream(files), rule), str(tmp_path / f"cp{files}"), str(tmp_path / f"out{files}"))
        assert rows_of(spark.read.parquet(str(tmp_path / f"out{files}"))) == want


def test_appended_csv_batches_count_once(spark, events, tmp_path):
    """A batch that is written again takes the place of its first writing, and the fold's state goes on over files."""
    rule, out = bars.Rule("standard", "volume", 500.0), str(tmp_path / "csv")
    feed = feeds.Feed(events.withColumn("part", feeds.slices_by_time("ts", ["2024-01-11", "2024-01-21"])), "part", form="csv", header=True, timestampNTZFormat=S.CSV_TIME)
    written = []

    def twice(df, number):
        S.append_csv(df, out, number)
        S.append_csv(df, out, number)  # as after a failure between writing and the commit of the batch
        written.append(number)

    for k in range(3):
        feed.arrive(k)
        feeds.advance(B.stream_bars(feed.stream(), rule), str(tmp_path / "checkpoint"), batch=twice)
    assert len(written) >= 3
    got = rows_of(S.appended_csv(spark, out, f"symbol string, {BARS_DDL}"))
    want = rows_of(bars.fold_bars(events, rule))
    assert len(want) > 5 and got == want
    before = len(got)
    S.append_csv(spark.createDataFrame([], f"symbol string, {BARS_DDL}"), out, 99)
    assert len(rows_of(S.appended_csv(spark, out, f"symbol string, {BARS_DDL}"))) == before


def test_late_ticks_are_counted_aside(spark):
    hour = lambda h, m, k, price, part: ("a", f"2024-01-01 {h:02d}:{m:02d}:00", k, price, 2.0, part)
    rows = [hour(0, 10, 1, 5.0, 0), hour(0, 50, 2, 7.0, 0), hour(1, 20, 3, 6.0, 0)]
    rows += [hour(0, 55, 4, 9.0, 1), hour(1, 5, 5, 1.0, 1), hour(2, 5, 6, 4.0, 1)]  # 00:55 is late, 01:05 isn't
    rows += [hour(0, 1, 7, 9.0, 2), hour(0, 2, 8, 9.0, 2), hour(1, 59, 9, 8.0, 2), hour(3, 30, 10, 2.0, 2)]  # 01:59 within the delay
    rows += [("b", "2024-01-01 00:00:30", 11, 3.0, None, 2), ("b", "2024-01-01 09:00:00", 12, None, 1.0, 2), (None, "2024-01-01 09:00:00", 13, 1.0, 1.0, 2)]
    got = feeds.run_feed(feeds.Feed(ticks_of(spark, rows), "c0"), 3, lambda s: B.stream_buckets(s, "H", 1, 600), B.BUCKETS_DDL).cache()
    base = 473352  # hours before 2024-01-01
    found = sorted((r.symbol, r.bar_id - base, r.open, r.high, r.low, r.close, r.cumulative_volume, r.cumulative_ticks) for r in B.time_bars_of(got, "H").collect())
    assert found == [("a", 0, 5.0, 7.0, 5.0, 7.0, 4.0, 2), ("a", 1, 1.0, 8.0, 1.0, 8.0, 6.0, 3), ("a", 2, 4.0, 4.0, 4.0, 4.0, 2.0, 1), ("b", 0, 3.0, 3.0, 3.0, 3.0, 0.0, 1)]
    assert sorted((r.symbol, r.bar_id - base, r.late_ticks) for r in B.late_ticks_of(got).collect()) == [("a", 0, 3)]


def test_buckets_equal_time_bars_where_none_is_late(spark, events):
    feed = feeds.Feed(events.withColumn("part", feeds.slices_by_time("ts", ["2024-01-11", "2024-01-21"])), "part")
    got = feeds.run_feed(feed, 3, lambda s: B.stream_buckets(s, "H"), B.BUCKETS_DDL)
    names = ["symbol", "bar_id", "date_time", "open", "high", "low", "close", "cumulative_ticks"]
    want = bars.time_bars(events, "H").withColumn("cumulative_ticks", F.col("cumulative_ticks").cast("long")).select(names)
    assert rows_of(B.time_bars_of(got, "H").select(names)) == rows_of(want)
    assert B.late_ticks_of(got).count() == 0


def test_spark_watermark_drops_late_ticks(spark, tmp_path):
    rows = [("a", f"2024-01-01 {k // 2:02d}:{30 * (k % 2):02d}:00", k, float(k), 1.0, k // 6) for k in range(12)] + [("a", "2024-01-01 00:10:00", 50, 9.0, 1.0, 2), ("a", "2024-01-01 09:10:00", 51, 9.0, 1.0, 2)]
    feed = feeds.Feed(ticks_of(spark, rows), "c0")
    for k in range(3):
        feed.arrive(k)
        feeds.advance(B.stream_time_bars(feed.stream(), "H"), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("cumulative_ticks")).first()[0] == 12  # without the late one and the open bucket
    names = ["symbol", "date_time", "open", "high", "low", "close"]
    want = bars.time_bars(ticks_of(spark, rows[:12] + rows[13:]).drop("c0"), "H")
    assert rows_of(got.select(names)) == rows_of(want.select(names))


NAN = float("nan")


@pytest.mark.parametrize("metric", ["tick", "volume", "dollar"])
def test_missing_prices_and_volumes(spark, metric):
    """The SQL forms, the fold and the stream agree: a missing price keeps the sign and the last price before it."""
    prices = [100.0, 101.0, None, 99.0, NAN, 99.0, 102.0, None, None, 103.0, 100.0, 100.0]
    volumes = [10.0, 10.0, 10.0, None, 10.0, NAN, 10.0, 10.0, 0.0, 10.0, 10.0, 10.0]
    rows = [("a", f"2024-01-01 00:00:{k:02d}", k, p, v, k // 5) for k, (p, v) in enumerate(zip(prices, volumes))]
    rows += [("b", f"2024-01-01 00:00:{k:02d}", k, None, 10.0, 0) for k in range(4)]
    t = ticks_of(spark, rows).drop("c0")
    signs = [r.sign for r in bars.tick_rule(t).filter("symbol = 'a'").orderBy("seq").collect()]
    assert signs == [0.0, 1.0, 1.0, -1.0, -1.0, -1.0, 1.0, 1.0, 1.0, 1.0, -1.0, -1.0]
    threshold = {"tick": 4.0, "volume": 25.0, "dollar": 2000.0}[metric]
    rule = bars.Rule("standard", metric, threshold)
    folded = rows_of(bars.fold_bars(t, rule))
    if metric == "tick":
        assert rows_of(bars.tick_bars(t, 4)) == folded
        assert [(r.open, r.close, r.cumulative_volume, r.cumulative_buy_volume) for r in bars.tick_bars(t, 4).filter("symbol = 'b'").collect()] == [(None, None, 40.0, 0.0)]
    streamed = feeds.run_feed(feeds.Feed(ticks_of(spark, rows), "c0"), 3, lambda s: B.stream_bars(s, rule), f"symbol string, {BARS_DDL}")
    assert rows_of(streamed) == folded and len(folded) > 1
    for kind in ("imbalance", "run") if metric == "dollar" else ():
        rule = bars.Rule(kind, metric, 0.0, 2.0, 5)
        streamed = feeds.run_feed(feeds.Feed(ticks_of(spark, rows), "c0"), 3, lambda s, r=rule: B.stream_bars(s, r), f"symbol string, {BARS_DDL}")
        assert rows_of(streamed) == rows_of(bars.fold_bars(t, rule))


def test_ticks_from_csv_and_text(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    lines = ["date_time,price,volume"] + [f"2024-01-01T00:00:{k % 3:02d}.000001,{k}.5,{k}" for k in range(5)]
    (tmp_path / "csv" / "b.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "csv" / "a.csv").write_text("date_time,price,volume\n2024-01-01T00:00:09.000000,1.5,\nbroken,x,3\n")
    (tmp_path / "csv" / "c.csv").write_text("date_time,price,volume\n")
    got = S.ticks_from_csv(spark, str(tmp_path / "csv")).orderBy("seq").collect()
    assert [(r.seq, r.price, r.volume) for r in got] == [(0, 1.5, None), (1, None, 3.0)] + [(k + 2, k + 0.5, float(k)) for k in range(5)]
    assert str(got[2].ts) == "2024-01-01 00:00:00.000001" and got[1].ts is None
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.txt").write_text("1.5\n\n 2\nword\n")
    (tmp_path / "x" / "2.txt").write_text("-3e2\n")
    assert [tuple(r) for r in S.text_floats(spark, str(tmp_path / "x")).orderBy("pos").collect()] == [(0, 1.5), (2, 2.0), (3, None), (4, -300.0)]
