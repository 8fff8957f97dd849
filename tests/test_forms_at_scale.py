"""Forms that are spread over tasks or take one pass give what plain ones give on all pairs or all rows."""

import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions.special import adf_pvalue, adf_statistic, digamma, ols_t
from fathomline.operators import backtest, breaks, dependence, entropy, fracdiff, importance, labels, matrix, neighbours, validation


def points(spark, groups):
    rows = [(g, k, None if x is None else float(x), None if y is None else float(y)) for g, xs, ys in groups for k, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "symbol string, seq long, x double, y double")


def plain_ksg(x, y, k=4):
    n = len(x)
    if n < 2:
        return 0.0
    row = np.arange(n)
    j = [((row * f % 2**32) / 2**32 - 0.5) * (v.std() or 1.0) * 1e-10 + v for f, v in zip(neighbours.JITTER.values(), (x, y))]
    dx, dy = (np.abs(v[:, None] - v) for v in j)
    k = min(k, n - 1)
    r = (np.sort(np.maximum(dx, dy), axis=1)[:, k] * (1 - 1e-10))[:, None]
    nx, ny = ((d <= r).sum(1) - 1 for d in (dx, dy))
    return digamma(float(k)) + digamma(float(n)) - float((digamma(np.maximum(nx, 0) + 1.0) + digamma(np.maximum(ny, 0) + 1.0)).mean())


@pytest.mark.parametrize("least", [5, 40])
def test_ksg_by_stripes(spark, least):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(700)
    # dependent, tied, constant, clustered far apart, few rows
    groups = [("a", x, x + 0.3 * rng.standard_normal(700)), ("b", rng.integers(0, 9, 400), rng.integers(0, 4, 400)), ("c", np.ones(60), rng.random(60)), ("d", np.concatenate([rng.random(150), 1e6 + rng.random(150)]), rng.random(300) ** 9), ("e", [1, 2, 3], [3, 1, 2]), ("f", [5], [6])]
    p = points(spark, groups)
    extra = points(spark, [("a", [None, math.nan, 1.0], [1.0, 2.0, math.inf]), (None, [1, 2], [1, 2])])
    got = {r.symbol: r.ksg for r in neighbours.ksg_information(p.union(extra), "x", "y", least_stripe=least).collect()}
    assert sorted(got) == list("abcdef")
    for g, a, b in groups:
        assert got[g] == pytest.approx(plain_ksg(np.asarray(a, float), np.asarray(b, float)), abs=1e-9), g
    assert neighbours.ksg_information(p.filter("false"), "x", "y").count() == 0


def test_ksg_stripes_are_small(spark):
    """No task of a stripe has more than about the root of a key's rows."""
    rng = np.random.default_rng(3)
    p = points(spark, [("a", rng.standard_normal(4000), rng.standard_normal(4000))])
    pts = neighbours.jittered(p, "x", "y", "symbol", "seq")
    s = neighbours.Stripes(pts, "x", 4, 5)
    sizes = [r["count"] for r in s.points.groupBy("stripe").count().collect()]
    assert max(sizes) <= 2 * math.ceil(math.sqrt(4 * 4000)) and max(sizes) - min(sizes) <= 1
    ranks = sorted((r["rank"], r.x) for r in s.points.collect())
    assert [k for k, _ in ranks] == list(range(4000)) and [x for _, x in ranks] == sorted(x for _, x in ranks)


def plain_dcor(x, y):
    a, b = (np.abs(v[:, None] - v) for v in (x, y))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    scale = math.sqrt((a * a).mean() * (b * b).mean())
    return math.sqrt(max((a * b).mean(), 0) / scale) if scale > 0 else 0.0


def test_distance_correlation_by_merging(spark):
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 64, 257):
        for x, y in ((rng.standard_normal(n), rng.standard_normal(n)), (rng.integers(0, 4, n).astype(float), rng.integers(0, 3, n).astype(float)), (np.arange(n) * 1.0, np.arange(n) ** 2.0), (np.ones(n), rng.random(n))):
            assert dependence.distance_correlation(x, y) == pytest.approx(plain_dcor(x, y), abs=1e-7)
    got = dependence.distance_correlations(points(spark, [("a", [1, 2, 3, None], [1, 4, 9, 1])]), "x", "y").collect()
    assert got[0].dcor == pytest.approx(plain_dcor(np.array([1.0, 2, 3]), np.array([1.0, 4, 9])))


def test_distance_correlation_of_a_million():
    rng = np.random.default_rng(5)
    x = rng.standard_normal(1_000_000)
    began = time.process_time()
    assert 0.4 < dependence.distance_correlation(x, x + 2 * rng.standard_normal(len(x))) < 0.45
    assert time.process_time() - began < 60


def series(spark, x, symbol="a"):
    return spark.createDataFrame([(symbol, k, float(v)) for k, v in enumerate(x)], "symbol string, ts long, x double")


@pytest.mark.parametrize("constant, lags", [("nc", 0), ("c", 1), ("ct", 2), ("ctt", 0)])
def test_recursive_least_squares(spark, constant, lags):
    rng = np.random.default_rng(6)
    x = 4 + np.cumsum(rng.standard_normal(60)) / 10
    s = series(spark, x).union(series(spark, np.ones(30), "flat")).union(series(spark, [1.0, 2.0], "short"))
    y, z, pos = breaks.design(x, constant, lags)
    got = {r.pos: r.adf for r in breaks.expanding_adf(s, 12, constant, lags).filter("symbol = 'a'").collect()}
    assert sorted(got) == pos[11:].tolist()
    for k, p in enumerate(pos[11:], 12):
        assert got[p] == pytest.approx(ols_t(y[:k], z[:k]), rel=1e-6, abs=1e-8)
    back = {r.pos: r.adf for r in breaks.backward_adf(s, 12, constant, lags).filter("symbol = 'a'").collect()}
    assert sorted(back) == pos[: len(y) - 11].tolist()
    for k in range(len(y) - 11):
        assert back[pos[k]] == pytest.approx(ols_t(y[k:], z[k:]), rel=1e-6, abs=1e-8)
    t = [ols_t(y[k:], z[k:]) for k in range(len(y) - 11)]
    cut = np.quantile(t, 0.95)
    r = breaks.quantile_adf(s, 12, constant, lags).filter("symbol = 'a'").collect()[0]
    assert (r.sadf, r.qadf, r.cadf) == pytest.approx((max(t), cut, np.mean([v for v in t if v >= cut])), rel=1e-6)
    errors = []
    for k in range(z.shape[1] + 1, len(y)):
        inv = np.linalg.inv(z[:k].T @ z[:k])
        errors.append((y[k] - z[k] @ inv @ z[:k].T @ y[:k]) / math.sqrt(1 + z[k] @ inv @ z[k]))
    want = np.cumsum(errors) / np.std(errors, ddof=1)
    found = sorted((r.pos, r.cusum) for r in breaks.brown_durbin_evans(s, constant, lags).filter("symbol = 'a'").collect())
    assert [p for p, _ in found] == pos[z.shape[1] + 1 :].tolist()
    assert [v for _, v in found] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-7)
    # a series whose regressors can't be told apart, or that is too short, has no statistic
    assert breaks.expanding_adf(s, 12, constant, lags).filter("symbol <> 'a' AND adf IS NOT NULL").count() == 0
    assert breaks.backward_sup_adf(s, 12, constant, lags).filter("symbol = 'flat' AND bsadf IS NOT NULL").count() == 0


def test_a_fold_goes_on_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = np.cumsum(np.random.default_rng(7).standard_normal(50))
    whole = sorted(map(tuple, breaks.expanding_adf(series(spark, x), 10).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, breaks.expanding_adf(series(spark, x), 10).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_triangles_are_tiles_of_equal_work(spark):
    n, tile = 5000, breaks.TILE
    ends = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("r2"))
    starts = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("r1"))
    pairs = breaks.triangle(ends, "r2", starts, "r1").filter("r1 <= r2")
    assert pairs.count() == n * (n + 1) // 2
    work = pairs.groupBy(F.floor(F.col("r1") / tile), F.floor(F.col("r2") / tile)).count()
    sizes = sorted(r["count"] for r in work.collect())
    assert sizes[-1] <= tile**2 <= 2 * sizes[len(sizes) // 2]
    # keys of their own, gaps, and starts after every end
    few = spark.createDataFrame([("a", 3), ("a", 900), ("b", 5), (None, 1)], "symbol string, r2 long")
    some = spark.createDataFrame([("a", 0), ("a", 2), ("a", 899), ("a", 5000), ("b", 4), ("c", 1)], "symbol string, r1 long")
    got = breaks.triangle(few, "r2", some, "r1").filter("r1 <= r2").select("symbol", "r2", "r1").collect()
    assert sorted(map(tuple, got)) == [("a", 3, 0), ("a", 3, 2), ("a", 900, 0), ("a", 900, 2), ("a", 900, 899), ("b", 5, 4)]


def test_psy_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(breaks, "TILE", 16)
    x = np.cumsum(np.random.default_rng(8).standard_normal(70))
    a, b = breaks.sup_adf(x, 12)
    got = {r.pos: r for r in breaks.psy_sequences(series(spark, x), 12).collect()}
    for k in range(70):
        if np.isfinite(b[k]):
            assert (got[k + 1].sadf, got[k + 1].bsadf) == pytest.approx((a[k], b[k]), rel=1e-6)


@pytest.mark.parametrize("width", [16, 1 << 13])
def test_differences_over_the_past_by_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(fracdiff, "BLOCK", width)
    monkeypatch.setattr(fracdiff, "MOST_LAGS", 3)
    rng = np.random.default_rng(9)
    x, y = 50 + np.cumsum(rng.standard_normal(150)), rng.standard_normal(40)
    gaps = x.copy()
    gaps[[5, 70]] = np.nan
    s = series(spark, x).union(series(spark, y, "b")).union(series(spark, [1.0], "c"))
    s = s.union(spark.createDataFrame([("g", k, None if math.isnan(v) else float(v)) for k, v in enumerate(gaps)], s.schema)).union(spark.createDataFrame([(None, 1, 2.0)], s.schema))
    for got, plain in ((fracdiff.frac_diff_expanding(s, 0.4, 0.3), lambda v: fracdiff.expanding_difference(v, 0.4, 0.3)), (fracdiff.ffd(s, 0.4, 0.01), lambda v: fracdiff.fixed_difference(v, 0.4, 0.01))):
        found = {(r.symbol, r.ts): r[3] for r in got.collect()}
        assert len(found) == 150 + 40 + 1 + 150
        for name, v in (("a", x), ("b", y), ("c", np.ones(1)), ("g", gaps)):
            for k, want in enumerate(plain(v)):
                have = found[name, k]
                assert (have is None) == bool(np.isnan(want)), (name, k)
                assert have is None or have == pytest.approx(want, abs=1e-8)
        assert any(v is not None for (g, _), v in found.items() if g == "a")


def long_table(spark, d):
    n = len(d)
    return spark.createDataFrame([(i + 1, j + 1, float(d[i, j])) for i in range(n) for j in range(n)], "i int, j int, v double")


def plain_linkage(d):
    """Merges by repeated search of the two nearest clusters; of equals, the ones with the least pair of items."""
    groups = {i: (i,) for i in range(len(d))}
    out = []
    while len(groups) > 1:
        v, i, j = min((d[i, j], min(i, j), max(i, j)) for a in groups for b in groups if a < b for i in groups[a] for j in groups[b])
        a, b = sorted(g for g, items in groups.items() if i in items or j in items)
        out.append((a, b, v, len(groups[a]) + len(groups[b])))
        groups[len(d) + len(out) - 1] = groups.pop(a) + groups.pop(b)
    return np.array(out)


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_trees_and_linkage(spark, ties):
    rng = np.random.default_rng(10)
    d = rng.integers(1, 4, (14, 14)).astype(float) if ties else rng.random((14, 14))
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 0)
    tree = matrix.spanning_tree(long_table(spark, d))
    own = matrix.matrix_tree(d)
    assert [(v, i - 1, j - 1) for v, i, j in tree] == own and len(tree) == 13
    assert matrix.linkage(own, 14).tolist() == plain_linkage(d).tolist()
    assert sorted(matrix.quasi_diagonal(matrix.single_linkage(d))) == list(range(1, 15))
    # items that nothing joins stay apart
    apart = long_table(spark, d).filter("(i <= 7) = (j <= 7)")
    assert len(matrix.spanning_tree(apart)) == 12
    assert matrix.spanning_tree(apart.filter("false")) == []


def test_hierarchical_weights_of_a_table(spark):
    x = np.random.default_rng(11).standard_normal((60, 8)) @ np.random.default_rng(12).standard_normal((8, 8))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    cov = np.cov(x.T)
    assert matrix.hierarchical_weights(matrix.covariance(rows, "v", 8), 8) == pytest.approx(matrix.hierarchical_risk_parity(cov, matrix.cov_to_corr(cov)), rel=1e-9)


def test_two_thousand_assets():
    x = np.random.default_rng(13).standard_normal((300, 2000))
    cov = np.cov(x.T)
    began = time.process_time()
    w = matrix.hierarchical_risk_parity(cov, matrix.cov_to_corr(cov))
    assert w.sum() == pytest.approx(1) and (w > 0).all() and time.process_time() - began < 60


def test_rows_are_projected_where_they_lie(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((80, 5)) * [1, 2, 3, 0, 5] + 7
    x[:, 2] = x[:, 1] + 0.01 * x[:, 2]
    rows = [(k, v.tolist(), "kept") for k, v in enumerate(x)] + [(90, None, "n"), (91, [1.0, None, 1.0, 1.0, 1.0], "n"), (92, [1.0], "n")]
    df = spark.createDataFrame(rows, "id int, v array<double>, components string").repartition(3)
    for threshold in (0.8, 0.95, 1.0):
        got = {r["id"]: r for r in matrix.orthogonal_rows(df.drop("components"), "v", 5, threshold).collect()}
        assert [got[k].components for k in (90, 91, 92)] == [None] * 3
        z, w, _, _ = matrix.orthogonal_features(x[:, [0, 1, 2, 4]], threshold)
        own = np.array([got[k].components for k in range(80)])[:, : z.shape[1]]
        assert np.abs(own) == pytest.approx(np.abs(z), abs=1e-7)  # vectors' signs are free
        assert own.T @ own == pytest.approx(np.diag(w), abs=1e-6)
    assert matrix.orthogonal_rows(df.drop("components").filter("false"), "v", 5).collect() == []


def plain_tau(x, y):
    def one(key):
        w = np.empty(len(x))
        w[np.argsort(-key, kind="stable")] = 1.0 / np.arange(1, len(x) + 1)
        pair = np.triu(w[:, None] + w, 1)
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        return (pair * sx * sy).sum() / math.sqrt((pair * np.abs(sx)).sum() * (pair * np.abs(sy)).sum())

    return (one(x) + one(y)) / 2


def test_weighted_tau_by_merging(spark):
    rng = np.random.default_rng(15)
    for n in (2, 5, 33, 200):
        for x, r in ((rng.random(n), rng.permutation(n) + 1), (np.append(rng.integers(0, 4, n - 1), 9.0), np.append(rng.integers(1, 5, n - 1), 7))):
            assert importance.weighted_tau(x, r) == pytest.approx(plain_tau(np.asarray(x, float), 1.0 / r), abs=1e-9)
    assert math.isnan(importance.weighted_tau([1, 1, 1], [1, 2, 3]))
    began = time.process_time()
    importance.weighted_tau(rng.random(200_000), rng.permutation(200_000) + 1)
    assert time.process_time() - began < 60
    rows = [("a", 1, 0.5), ("a", 2, 0.2), ("a", 3, 0.8), ("a", 4, 0.1), ("a", None, 1.0), ("a", 5, None), ("b", 1, 1.0), (None, 1, 1.0)]
    got = {r.k: r.tau for r in importance.weighted_taus(spark.createDataFrame(rows, "k string, rank int, importance double"), "importance", "rank", "k").collect()}
    assert got == {"a": pytest.approx(0.2), "b": None}


def returns_of(rng, n):
    return rng.standard_normal(n) / 20


def test_expected_drawdowns_by_windows(spark):
    rng = np.random.default_rng(16)
    groups = {"a": returns_of(rng, 60), "b": returns_of(rng, 6), "c": np.zeros(20), "d": np.array([0.1, -1.0, 0.5, 0.2, -0.1, 0.3, 0.4, 0.1, 0.2, 0.1, 0.3, 0.2]), "e": np.array([0.1])}
    s = spark.createDataFrame([(g, k, float(v)) for g, x in groups.items() for k, v in enumerate(x)] + [("a", 999, None), (None, 1, 0.5)], "symbol string, ts long, x double")
    for horizon, alpha in ((10, 0.9), (5, 0.55), (1, 0.9)):
        got = {r.symbol: r.ced for r in backtest.conditional_expected_drawdown(s, horizon, alpha).collect()}
        for g in "abce":
            assert got[g] == pytest.approx(backtest.expected_drawdown(groups[g], horizon, alpha), abs=1e-9), (g, horizon)
    # all is lost in the second row: a drawdown of 1 for the window that begins before it, none for those after
    assert {r.symbol: r.ced for r in backtest.conditional_expected_drawdown(s, 10, 0.9).collect()}["d"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        backtest.conditional_expected_drawdown(s, 5, 1.0)
    assert backtest.conditional_expected_drawdown(s.filter("false"), 5).count() == 0


@pytest.mark.parametrize("lag", [None, 3, 0])
def test_sharpe_inference_as_a_plan(spark, lag):
    rng = np.random.default_rng(17)
    groups = {"a": returns_of(rng, 300), "b": returns_of(rng, 12) + 0.1, "c": np.ones(9), "d": np.array([0.1, 0.2]), "e": np.array([1.0])}
    s = spark.createDataFrame([(g, k, float(v)) for g, x in groups.items() for k, v in enumerate(x)] + [("a", 999, None)], "symbol string, ts long, x double")
    got = {r.symbol: r.asDict() for r in backtest.sharpe_inferences(s, lag=lag).collect()}
    assert sorted(got) == sorted(groups)
    for g, x in groups.items():
        for k, want in backtest.sharpe_inference(x, lag=lag).items():
            if isinstance(want, float) and math.isnan(want):
                assert got[g][k] is None, (g, k)
            else:
                assert got[g][k] == pytest.approx(want, rel=1e-8, abs=1e-9), (g, k)


def test_gates_and_benchmarks(spark):
    rng = np.random.default_rng(18)
    groups = {"a": returns_of(rng, 200) + 0.03, "b": returns_of(rng, 3), "c": np.ones(5), "d": np.array([2.0])}
    s = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(None, 1.0), ("a", None)], "symbol string, x double")
    for r in validation.deflated_sharpe_gates(s, 20, 0.1).collect():
        want = validation.deflated_sharpe_gate(groups[r.symbol], 20, 0.1)
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-7), (r.symbol, k)
    for ratios in ([0.1, 0.5, -0.2, 0.7], [0.4], []):
        df = spark.createDataFrame([(v,) for v in ratios] + [(None,)], "sr double")
        assert backtest.benchmark_sharpes(df).first()[0] == pytest.approx(backtest.benchmark_sharpe(ratios), abs=1e-7)


def test_information_passes_over_unknown_values(spark):
    rows = [("a", float(k % 5), float(k % 3)) for k in range(40)]
    clean = spark.createDataFrame(rows, "symbol string, x double, y double")
    dirty = clean.union(spark.createDataFrame([("a", None, 1.0), ("a", 1.0, math.nan), (None, 9.0, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], clean.schema))
    want = dependence.information(clean, "x", "y", 4).collect()[0]
    got = {r.symbol: r for r in dependence.information(dirty, "x", "y", 4).collect()}
    assert sorted(got) == ["a", "b"] and got["a"].mi == pytest.approx(want.mi) and got["b"].mi == 0


def test_each_key_has_its_number_of_bins(spark):
    rng = np.random.default_rng(21)
    x = rng.standard_normal(500)
    groups = {"a": (x, x + rng.standard_normal(500)), "b": (x[:60], x[:60]), "c": (np.ones(9), x[:9]), "d": ([1.0], [2.0])}
    got = {r.symbol: r for r in dependence.variation_of_information_extended(points(spark, [(g, *v) for g, v in groups.items()]), "x", "y").collect()}
    assert sorted(got) == sorted(groups)
    for g, (a, b) in groups.items():
        r = float(np.corrcoef(a, b)[0, 1]) if g in "ab" else 0.0
        bins = dependence.number_of_bins(len(a), r)
        assert got[g].bins == bins
        if g in "ab":
            h, *_ = np.histogram2d(a, b, bins)
            ent = lambda v: float(-(v[v > 0] / v.sum() * np.log(v[v > 0] / v.sum())).sum())
            assert got[g].vi == pytest.approx(2 * ent(h.ravel()) - ent(h.sum(0)) - ent(h.sum(1)), abs=1e-9)


def test_daily_volatility_is_a_fold(spark):
    import pandas as pd

    rng = np.random.default_rng(19)
    start = pd.Timestamp("2024-01-01")
    close = np.exp(np.cumsum(rng.standard_normal(80)) / 10)
    rows = [("a", (start + pd.Timedelta(hours=7 * k)).to_pydatetime(), None if k in (20, 50) else float(c)) for k, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    got = sorted((r.ts, r.volatility) for r in labels.daily_volatility(df, 10).collect())
    x = pd.Series([np.nan if c is None else c for _, _, c in rows], index=[t for _, t, _ in rows])
    past = pd.Series([next((x.iloc[j] for j in range(k, -1, -1) if x.index[j] < x.index[k] - pd.Timedelta(days=1)), None) for k in range(80)], index=x.index, dtype=float)
    r = np.log(x / past)[past.notna()]
    want = r.ewm(span=10, adjust=True).std(bias=False)
    assert [t for t, _ in got] == list(want.index)
    for (_, v), w in zip(got, want):
        assert (v is None) == bool(np.isnan(w)) and (v is None or v == pytest.approx(w, rel=1e-9))


def test_bootstrap_paths_are_rows(spark):
    rng = np.random.default_rng(20)
    groups = {"a": np.cumsum(rng.standard_normal(40)), "b": np.exp(np.arange(30) / 12), "c": np.arange(5.0)}
    s = spark.createDataFrame([(g, k, float(v)) for g, x in groups.items() for k, v in enumerate(x)] + [("a", 999, None)], "symbol string, ts long, x double").repartition(3)
    got = {r.symbol: r.asDict() for r in breaks.volatility_robust_sadf(s, None, 29, 5).collect()}
    for g in "ab":
        for k, v in breaks.wild_bootstrap_sadf(groups[g], None, 29, 5).items():
            assert got[g][k] == pytest.approx(v), (g, k)
    assert got["c"]["sadf"] is None and got["c"]["reject_sadf"] is None


def test_open_barriers_meet_prices_by_time(spark):
    from datetime import datetime, timedelta

    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    prices = spark.createDataFrame([("a", at(k), p) for k, p in enumerate([100.0, 101.0, 90.0, 130.0, 70.0])] + [("b", at(0), 1.0)], "symbol string, ts timestamp_ntz, close double")
    events = spark.createDataFrame([("a", at(0), None, 0.2, 1.0), ("a", at(1), None, 9.0, 1.0), ("a", at(2), at(3), 0.3, -1.0), ("a", at(3), at(4), 0.1, 1.0), ("b", at(0), None, 0.1, 1.0), ("b", at(7), None, 0.1, 1.0)], "symbol string, event_start timestamp_ntz, barrier timestamp_ntz, base_width double, side double")
    got = {(r.symbol, r.event_start): r.end_time for r in labels.triple_barrier(prices, events, 1.0, 1.0).collect()}
    assert got == {("a", at(0)): at(3), ("a", at(1)): None, ("a", at(2)): at(3), ("a", at(3)): at(4), ("b", at(0)): None, ("b", at(7)): None}


def series_rows(spark, groups, columns="x double"):
    rows = [(g, k, *(v if isinstance(v, tuple) else (v,))) for g, xs in groups.items() for k, v in enumerate(xs)]
    return spark.createDataFrame(rows, f"symbol string, ts long, {columns}")


def test_chow_breaks_by_suffix_sums(spark):
    rng = np.random.default_rng(8)
    walks = {"a": np.cumsum(rng.standard_normal(60)).tolist(), "b": rng.random(13).tolist()}
    odd = {"null": [1.0, None, *range(2, 30)], "nan": [*map(float, range(20)), math.nan], "nought": [0.0] * 20, "short": [1.0, 2.0, 4.0], "one": [1.0]}
    odd = {g: [None if v is None else float(v) for v in xs] for g, xs in odd.items()}
    s = series_rows(spark, walks | odd)
    got = {(r.symbol, r.pos): r.dfc for r in breaks.chow_dickey_fuller(s, 5).collect()}
    for g, xs in walks.items():
        x = np.array(xs)
        d, level = np.diff(x), x[:-1]
        for k in range(5, len(d) - 5):
            assert got.pop((g, k)) == pytest.approx(ols_t(d, (level * (np.arange(len(d)) >= k))[:, None]), rel=1e-9), (g, k)
    assert {g for g, _ in got} == {"null", "nan", "nought"} and set(got.values()) == {None}
    assert breaks.chow_dickey_fuller(s.filter("false"), 5).count() == 0


def plain_grassberger(message, width):
    words = [message[i : i + width] for i in range(len(message) - width + 1)]
    if not words:
        return 0.0
    c = np.array([words.count(w) for w in set(words)], float)
    g = digamma(c) + 0.5 * (-1) ** c * (digamma((c + 1) / 2) - digamma(c / 2))
    return (math.log(c.sum()) - (c * g).sum() / c.sum()) / math.log(2) / width


@pytest.mark.parametrize("width", [1, 3])
def test_grassberger_by_counts(spark, width):
    rng = np.random.default_rng(9)
    texts = ["", "a", "ab", "aaaa", "\u00e9\U0001f600" * 7, "abc" * 5000, "".join(rng.choice(list("abcdef "), 3000)), None]
    m = spark.createDataFrame(list(enumerate(texts)), "id int, message string")
    got = {r.id: r.entropy for r in entropy.grassberger_entropy(m, width).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_grassberger(t or "", width), abs=1e-10), t
    assert entropy.grassberger_entropy(m.filter("false"), width).count() == 0


def test_sharpe_differences_as_a_plan(spark):
    rng = np.random.default_rng(10)
    pairs = {g: [(float(a), float(0.4 * a + b)) for a, b in zip(0.1 + rng.standard_normal(n), rng.standard_normal(n))] for g, n in (("a", 300), ("b", 27), ("c", 4))}
    odd = {"flat": [(1.0, float(k)) for k in range(9)], "one": [(1.0, 2.0)], "bare": [(None, 1.0), (math.nan, 2.0)]}
    gaps = {"a": [*pairs["a"], (None, 1.0), (math.nan, 2.0)]}
    p = series_rows(spark, pairs | gaps | odd, "a double, b double")
    for band in (0, None, 2):
        got = {r.symbol: r for r in backtest.sharpe_difference_tests(p, band).collect()}
        assert sorted(got) == ["a", "b", "c", "flat", "one"]
        for g, rows in pairs.items():
            a, b = np.array(rows).T
            lag = band if band is not None else math.ceil(round(len(a) ** (1 / 3), 12))
            delta, influence = backtest._difference(a, b)
            se = math.sqrt(backtest.long_run_variance(influence, lag, 1e-300) / len(a))
            assert got[g].delta == pytest.approx(delta, rel=1e-9) and got[g].se == pytest.approx(se, rel=1e-7), (g, band)
            assert got[g].pvalue == pytest.approx(math.erfc(abs(delta / se) / math.sqrt(2)), abs=1e-6) and got[g].reject == (got[g].pvalue < 0.05)
        assert got["flat"].stat is None and got["one"].pvalue is None and not got["flat"].reject
    assert backtest.sharpe_difference_tests(p.filter("false")).count() == 0


def plain_overfitting(p, parts):
    cuts = np.array_split(np.arange(len(p)), parts)
    n = np.array([len(c) for c in cuts], float)
    c = p - p.mean(0)
    s1, s2 = np.array([c[k].sum(0) for k in cuts]), np.array([(c[k] ** 2).sum(0) for k in cuts])
    train = np.array([[k in t for k in range(parts)] for t in combinations(range(parts), parts // 2)], float)

    def ratio(m):
        size = (m @ n)[:, None]
        mean = m @ s1 / size
        sd = np.sqrt(np.maximum(m @ s2 / size - mean**2, 0))
        return np.where(sd > 1e-14, (mean + p.mean(0)) / np.where(sd > 1e-14, sd, 1), 0.0)

    best, test = ratio(train).argmax(1), ratio(1 - train)
    rank = test.argsort(1, kind="stable").argsort(1)[np.arange(len(best)), best] + 1
    return float((rank / (p.shape[1] + 1) <= 0.5).mean())


@pytest.mark.parametrize("parts", [2, 6, 10])
def test_half_splits_are_numbered_as_sorted_choices(spark, parts):
    want = {(k, p, p in c) for k, c in enumerate(combinations(range(1, parts + 1), parts // 2), 1) for p in range(1, parts + 1)}
    assert {tuple(r) for r in validation.half_splits(spark, parts).collect()} == want


def test_bags_of_overfitting(spark):
    p = np.random.default_rng(11).standard_normal((43, 7))
    p[:, 2] = 0.25
    perf = spark.createDataFrame([(t, s, float(x)) for t, row in enumerate(p) for s, x in enumerate(row)], "t long, strategy int, x double")
    drawn = validation.block_bootstrap(spark, 43, 5, 6, 3).collect()
    at = {b: [r.row for r in sorted(drawn, key=lambda r: r.pos) if r.draw == b] for b in range(6)}
    assert all(len(v) == 43 and all((b - a) % 43 == 1 for k, (a, b) in enumerate(zip(v, v[1:]), 1) if k % 5) for v in at.values())
    assert len({tuple(v) for v in at.values()}) == 6
    got = {r.bag: r.pbo for r in validation.bagged_overfitting(perf, 6, 6, 5, 3).collect()}
    assert sorted(got) == list(range(6))
    for b, v in at.items():
        assert got[b] == pytest.approx(plain_overfitting(p[v], 6)), b
    with pytest.raises(ValueError):
        validation.bagged_overfitting(perf.filter("t < 3"), 6)


def plain_orders(close, threshold):
    level = np.log(close)
    rows = []
    for d in np.linspace(0, 1, 11):
        x = fracdiff.fixed_difference(level, d, threshold)
        v = x[np.isfinite(x)]
        t = adf_statistic(v) if len(v) > 5 else np.nan
        rows.append((d, t, adf_pvalue(t), fracdiff.memory_kept(x, level)))
    return rows


@pytest.mark.parametrize("threshold", [0.01, 1e-3])
def test_orders_of_differences_from_moments(spark, threshold):
    rng = np.random.default_rng(12)
    walk = np.exp(np.cumsum(0.1 * rng.standard_normal(260)))
    holes = [float(v) for v in walk[:200]]
    holes[90] = holes[150] = math.nan
    groups = {"a": [float(v) for v in walk], "b": [float(v) for v in 2 + rng.random(180)], "holes": holes, "few": [1.0, 2.0, 3.0, 5.0], "flat": [3.0] * 30}
    s = series_rows(spark, groups | {"holes": [None if k == 150 else v for k, v in enumerate(holes)]}, "close double")
    got = {(r.symbol, r.d): r for r in fracdiff.optimal_ffd(s, threshold).collect()}
    assert len(got) == 11 * len(groups)
    for g in ("a", "b", "holes", "few"):
        for d, *want in plain_orders(np.array(groups[g]), threshold):
            r = got[g, d]
            for x, y in zip((r.adf, r.p_value, r.correlation), want):
                assert (x is None) if not math.isfinite(y) else x == pytest.approx(y, rel=1e-6, abs=1e-7), (g, d, r, want)
    assert all(got["flat", d].correlation is None or d > 0 for d in np.linspace(0, 1, 11))
    assert fracdiff.optimal_ffd(s.filter("false"), threshold).count() == 0
