"""Queries give their SQL's rows on inputs that the smallest tables don't have."""

import math

import pytest

from fathomline.operators import bars
from fathomline.plans import catalogue

duckdb = pytest.importorskip("duckdb")
EVENTS = "read_parquet('/root/testdata/sf0.1/events.parquet')"


def both(spark, folder, name, events):
    """Rows of a query and of its SQL over a selection of events, sorted."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS {events}")
    con.execute(f"COPY events TO '{folder}/events.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = catalogue.queries()[name](spark, str(folder)).select(*names).collect()
    return sorted(map(tuple, got), key=repr), sorted(found.fetchall(), key=repr)


def test_last_mean_is_that_of_sql():
    """To the last digit: 0.3 and its like are where running sums and sums of powers part."""
    con = duckdb.connect()
    for values in ([0.5, 1 / 3, 0.25, 0.8, 0.2], [4.0, 5.0, 7.0], [3.0], [2.0, 9.0, 4.0, 4.0], [0.6, 0.75, 1 / 7]):
        want = con.execute("SELECT " + catalogue._LAST_EWMA.format(l="$v", w=5), {"v": values}).fetchone()[0]
        assert bars.last_ewma(values, 5) == want
    assert math.isnan(bars.last_ewma([], 5))


def test_run_bars_close_where_sql_closes_them(spark, tmp_path):
    """The limit of a bar is exactly 3 here, which sums added otherwise put a digit above."""
    got, want = both(spark, tmp_path, "tick_run_expected", f"SELECT * FROM {EVENTS} WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 7700")
    assert len(got) > 800 and got == want


@pytest.mark.parametrize("low", ["0.0", "-2.5", "'NaN'"])
def test_edge_of_prices_without_logarithm(spark, tmp_path, low):
    """A single such price leaves its symbol without a spread, and no other."""
    got, want = both(spark, tmp_path, "edge_spread", f"SELECT * REPLACE (CASE WHEN event_id = 500 THEN {low} ELSE greatest(value, 1) END::DOUBLE AS value) FROM {EVENTS} WHERE event_id < 20000")
    assert repr(got) == repr(want) and len(got) == 5
    assert sum(math.isnan(x) for _, x in got) == 1
