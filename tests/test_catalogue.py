"""Each registered query that has SQL gives that SQL's rows on the smallest tables; the others give rows."""

import math

import pytest

from fathomline.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    got, want = as_rows(df.columns, map(tuple, df.collect())), as_rows(names, found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["dollar_run_expected", "entropy_nsb", "pelt_change_points", "hrp_weights", "importance_mda", "synthetic_backtest"])
def test_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
