"""Canonical schemas and their validation at plan time."""

from __future__ import annotations

from pyspark.sql import DataFrame

TICKS = {"symbol": "string", "ts": "timestamp_ntz", "seq": "bigint", "price": "double", "volume": "double"}
BARS = ("symbol", "bar_id", "date_time", "tick_index", "open", "high", "low", "close", "cumulative_volume", "cumulative_buy_volume", "cumulative_sell_volume", "cumulative_ticks", "cumulative_dollar_value", "threshold")
BARS_DDL = "bar_id long, date_time timestamp_ntz, tick_index long, open double, high double, low double, close double, cumulative_volume double, cumulative_buy_volume double, cumulative_sell_volume double, cumulative_ticks double, cumulative_dollar_value double, threshold double"


def validate(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with the schema's columns in order; raises for a missing column or another type."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c)} instead of {t}" for c, t in schema.items() if have.get(c) != t]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*schema)
