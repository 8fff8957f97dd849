"""Column factories over ordered series; every window is partitioned by the series' key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(key: str = "symbol", *by: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*(by or ("ts",)))


def rolling(agg: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """agg over the last n rows, null until there are n values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def first_difference(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def ewm_weights(span: float, n: int) -> list[float]:
    """Weights of the last n values, oldest first, of an adjusted exponential mean."""
    a = 2.0 / (span + 1.0)
    w = [(1 - a) ** k for k in range(n - 1, -1, -1)]
    return [x / sum(w) for x in w]


def ewma(df: DataFrame, column: str, window: int, key: str = "symbol", order: tuple[str, ...] = ("ts",), keep: tuple[str, ...] = ()) -> DataFrame:
    """key, order, keep and ewma: the adjusted exponential mean of all values so far, smoothing 2 / (window + 1)."""
    from .grouped import fold_series

    rest = 1 - 2 / (window + 1)
    carried = [*order, *[c for c in keep if c not in order]]
    kinds = dict(df.dtypes)

    def step(state: dict, rows) -> list:
        out = []
        for values in zip(rows[column].astype(float), *(rows[c] for c in carried)):
            state["sum"], state["weight"] = state.get("sum", 0.0) * rest + values[0], state.get("weight", 0.0) * rest + 1
            out.append((*values[1:], state["sum"] / state["weight"]))
        return out

    needed = df.select(key, *carried, *([column] if column not in carried else []))
    return fold_series(needed, key, list(order), dict, step, [*carried, "ewma"], ", ".join(f"{c} {kinds[c]}" for c in carried) + ", ewma double")


def ewma_bounded(x: Column, w: WindowSpec, span: float, n: int) -> Column:
    """Exponential mean over the last n rows as a weighted sum: no Python, no recursion."""
    a = 2.0 / (span + 1.0)
    values = F.reverse(F.collect_list(x).over(w.rowsBetween(-(n - 1), 0)))
    weight = F.transform(values, lambda v, k: v * F.pow(F.lit(1 - a), k))
    total = F.aggregate(F.transform(values, lambda v, k: F.pow(F.lit(1 - a), k)), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(weight, F.lit(0.0), lambda s, v: s + v) / total
