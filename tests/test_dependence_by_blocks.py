"""Distance correlation in blocks of rows and neighbours in windows give what all pairs give."""

import math

import numpy as np
import pytest
from test_forms_at_scale import plain_dcor, points

from fathomline.operators import dependence, neighbours


@pytest.mark.parametrize("least", [7, 1000])
def test_distance_correlation_by_blocks(spark, least):
    rng = np.random.default_rng(8)
    x = rng.standard_normal(300)
    # dependent, tied on both sides, constant, a far cluster, few rows
    groups = [("a", x, x + rng.standard_normal(300)), ("b", rng.integers(0, 6, 200), rng.integers(0, 3, 200)), ("c", np.ones(40), rng.random(40)), ("d", np.concatenate([rng.random(60), 1e4 + rng.random(60)]), rng.random(120) ** 9), ("e", [1, 2, 3], [3, 1, 2]), ("f", [5], [6])]
    p = points(spark, groups)
    extra = points(spark, [("a", [None, math.nan], [1.0, 2.0]), (None, [1, 2], [1, 2])])
    got = {r.symbol: r.dcor for r in dependence.distance_correlations(p.union(extra), "x", "y", least_block=least).collect()}
    assert sorted(got) == list("abcdef")
    for g, a, b in groups:
        assert got[g] == pytest.approx(plain_dcor(np.asarray(a, float), np.asarray(b, float)), abs=1e-7), g
    assert dependence.distance_correlations(p.filter("false"), "x", "y").count() == 0


def test_no_task_has_a_whole_key(spark, monkeypatch):
    """Rows reach Python by blocks of a bounded length, and a key's table of cells only by their number."""

    def guarded(f, most):
        def run(rows):
            assert len(rows) <= most
            return f(rows)

        return run

    monkeypatch.setattr(dependence, "_along_x", guarded(dependence._along_x, 101))
    monkeypatch.setattr(dependence, "_along_y", guarded(dependence._along_y, 101))
    monkeypatch.setattr(dependence, "_of_cells", guarded(dependence._of_cells, 100))
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 2, 1000).astype(float), np.ones(1000)
    y[::3] = x[::3]
    got = dependence.distance_correlations(points(spark, [("a", x, y)]), "x", "y", least_block=100).collect()
    assert got[0].dcor == pytest.approx(plain_dcor(x, y), abs=1e-7)


@pytest.mark.parametrize("n", [1, 3, 64, 65, 700])
def test_nearest_by_windows(n):
    rng = np.random.default_rng(n)
    ax, ay = rng.standard_normal(50), rng.integers(0, 4, 50) * 1.0
    for bx, by in ((rng.standard_normal(n), rng.standard_normal(n) ** 3), (rng.integers(0, 3, n) * 1.0, rng.integers(0, 4, n) * 1.0), (rng.random(n), np.ones(n))):
        for own, x, y in ((False, ax, ay), (True, bx, by)):
            k = min(4 + own, n)
            want = np.sort(np.maximum(np.abs(x[:, None] - bx), np.abs(y[:, None] - by)), axis=1)[:, int(own) : k]
            assert np.array_equal(neighbours._nearest(x, y, bx, by, 4, own), want)
