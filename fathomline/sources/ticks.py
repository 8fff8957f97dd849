"""Adapters from tables and files to ticks, daily series and performance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialise, table
from ..schemas import TICKS, validate


def ticks_from_events(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    e = table(spark, sf_dir, "events")
    volume = F.get_json_object("props", "$.k").cast("double") + 1.0
    return validate(e.select(F.col(symbol).cast("string").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), volume.alias("volume")), TICKS)


def numbered_rows(df: DataFrame, label: str) -> DataFrame:
    """Rows of files with seq, from 0 in order of file names and then of rows; df has the file's `_metadata`.

    Rows are numbered within their split where it is read and written once; the number that a split begins with
    comes from a table with a row a split, the only one that a single task sorts.
    """
    columns = df.columns
    at = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    at = materialise(at, label)
    splits = at.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(splits, ["_file", "_block"]).select(*columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("seq"))


TICK_CSV = "date_time timestamp_ntz, price double, volume double"
#: How times are written, to the microsecond.
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def ticks_from_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """date_time, price, volume rows as ticks of one symbol; seq follows the files' names and their rows.

    Columns that can't be read are null, as are those that a row lacks; files without rows give none.
    """
    raw = spark.read.option("timestampNTZFormat", CSV_TIME).csv(path, header=header, schema=TICK_CSV)
    rows = numbered_rows(raw, "csv-ticks")
    return rows.select(F.lit("all").alias("symbol"), F.col("date_time").alias("ts"), "seq", "price", "volume").select(*TICKS)


def append_csv(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch's rows as CSV files with headers, idempotent by its number: a batch that is written again
    takes the place of its first writing."""
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", CSV_TIME).csv(f"{path}/batch={batch_id}")


def appended_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that append_csv has written under path."""
    return spark.read.option("timestampNTZFormat", CSV_TIME).csv(f"{path}/batch=*", header=True, schema=schema)


def text_floats(spark: SparkSession, path: str) -> DataFrame:
    """One number per line as pos, x; positions follow the files' names and lines, blank lines count and are left
    out, and a line that is no number has a null x."""
    rows = numbered_rows(spark.read.text(path), "text-floats")
    return rows.filter(F.trim("value") != "").select(F.col("seq").alias("pos"), F.expr("try_cast(trim(value) AS double)").alias("x"))


def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (midnight), close and pnl of each event type's days."""
    d = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), d.alias("ts")).agg(F.round(F.sum("value"), 6).alias("pnl"), F.max_by("value", "event_id").alias("close"))


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, strategy, x: daily value per event type, less 100 per event, scaled."""
    e = table(spark, sf_dir, "events")
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    code = F.expr("array_position(array('click','error','purchase','signup','view'), event_type)").cast("int")
    return e.groupBy(days.alias("t"), code.alias("strategy")).agg(F.round(F.avg("value") - 49.0, 6).alias("x"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (order priority), ts, x: daily totals of orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("o_totalprice"), 4).alias("x"))
