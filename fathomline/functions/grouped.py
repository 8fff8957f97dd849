"""Grouped-map helper: numpy kernels on one ordered series per key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


def per_series(df: DataFrame, key: str, order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on each key's rows, sorted by `order`; the key is put first into the result.

    Only for folds whose next step depends on the last one, which no window can express.  A key's
    series must fit one task; keys are independent of each other.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = fn(rows.sort_values(order, kind="stable").reset_index(drop=True))
        out.insert(0, key, name[0])
        return out

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def fold_series(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, columns: list[str], schema: str) -> DataFrame:
    """Fold each key's rows in order with bounded memory: step(state, batch) -> result rows, where batch has
    rows of one key that follow those before it.

    Rows are dealt by key and sorted by Spark, which spills; a task goes through its sorted rows as Arrow
    batches and carries the state from one batch to the next, so a series may be longer than a task's memory.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches):
        name, state = None, None
        for rows in batches:
            out = []
            # batches are sorted by key, so each key is one run of rows
            new = (rows[key] != rows[key].shift()).cumsum()
            for _, part in rows.groupby(new, sort=False):
                if state is None or part[key].iloc[0] != name:
                    name, state = part[key].iloc[0], start()
                out += [(name, *r) for r in step(state, part)]
            if out:
                yield pd.DataFrame(out, columns=[key, *columns])

    ready = df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return ready.mapInPandas(run, f"{key} {kind}, {schema}")


def scalars(**values) -> pd.DataFrame:
    return pd.DataFrame({k: [v] for k, v in values.items()})


def nan_to_none(x: np.ndarray) -> pd.Series:
    """Nullable doubles: nan and infinities become null."""
    return pd.Series([float(v) if np.isfinite(v) else None for v in np.asarray(x, float)], dtype="object")
