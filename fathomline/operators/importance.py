"""Feature importance, cross-validated scores, search and bagging over tables of samples.

A sample is a row of (row, x array<double>, y int) and, for splits, pos, start and end.  Trees are grown in
tasks that read their samples from Spark: rows are dealt by hash to parts of about FIT_ROWS, each part to a few
lanes, and each tree is grown from one part by one lane.  With more than trees * FIT_ROWS rows the trees see
that many of them, a bounded sample; losses, importances, votes and scores are taken over all rows, with the
trees, which are small, sent to tasks.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grouped import per_series, scalars
from ..functions.special import sums_below, t_sf
from ..runtime import ship
from .matrix import covariance, to_numpy
from .trees import Forest, grow, log_loss, one_hot

#: Rows that a tree is grown from, at most about so many, and groups of trees that work side by side.
FIT_ROWS, LANES = 20_000, 16
#: Rows within which a column is permuted or a knock-off drawn.
CHUNK_ROWS = 5_000


@dataclass(frozen=True)
class Split:
    """Rows with pos from `first` to `last` are tested; others train if start > hi or end < lo."""

    first: int
    last: int
    lo: int
    hi: int

    def test(self, rows: pd.DataFrame) -> np.ndarray:
        return ((rows["pos"] >= self.first) & (rows["pos"] <= self.last)).to_numpy()

    def train(self, rows: pd.DataFrame) -> np.ndarray:
        return ~self.test(rows) & ((rows["start"] > self.hi) | (rows["end"] < self.lo)).to_numpy()


@dataclass(frozen=True)
class Spec:
    """A forest: what it is trained on, which columns it sees, and its shape."""

    split: Split | None = None
    columns: tuple[int, ...] | None = None
    trees: int = 50
    depth: int = 6
    subset: int | None = None


def samples(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> DataFrame:
    """A table of samples from small arrays."""
    return spark.createDataFrame(pd.DataFrame({"row": np.arange(len(x)), "x": [list(map(float, v)) for v in x], "y": np.asarray(y).astype(int)}), "row long, x array<double>, y int")


def with_folds(rows: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, list[Split]]:
    """Folds by hash of the row's number."""
    fold = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(k))
    return rows.withColumns({c: fold for c in ("pos", "start", "end")}), [Split(f, f, f, f) for f in range(k)]


def contiguous_splits(rows: DataFrame, k: int, embargo: float = 0.0) -> tuple[DataFrame, list[Split]]:
    """k blocks of equal size in order of start; what overlaps a block, or follows it within the embargo (a
    share of the rows), doesn't train.  Rows without start and end are points in order of their numbers."""
    if "start" not in rows.columns:
        rows = rows.withColumns({"start": F.col("row"), "end": F.col("row")})
    rows = rows.withColumn("pos", F.col("start"))
    n = rows.count()
    at = [F.percentile_approx("start", F.lit(j / k), F.lit(1_000_000)) for j in range(1, k)]
    low, high, *cuts = rows.agg(F.min("start"), F.max("start"), *at).first()
    edges = [low, *[c + 1 for c in cuts], high + 1]
    splits = []
    for first, after in zip(edges, edges[1:]):
        lo, hi, before = rows.agg(F.min(F.when(F.col("pos").between(first, after - 1), F.col("start"))), F.max_by("end", F.when(F.col("pos").between(first, after - 1), F.col("start"))), F.lit(0)).first()
        if lo is None:
            continue
        if step := int(n * embargo):
            before = rows.filter(F.col("start") < hi).count()
            hi = hi if before >= n else rows.agg(F.percentile_approx("start", F.lit(min(1.0, (before + step + 1) / n)), F.lit(1_000_000))).first()[0]
        splits.append(Split(first, after - 1, lo, max(hi, after - 1)))
    return rows, splits


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["x"].tolist(), float)


def per_tree(rows: DataFrame, items: int, fn: Callable, columns: str) -> DataFrame:
    """Result rows of fn(item, part's rows, its matrix), each item on one part of the samples."""
    ship(rows.sparkSession)
    parts = max(1, min(items, math.ceil(rows.count() / FIT_ROWS)))
    lanes = max(1, math.ceil(min(LANES, items) / parts))
    keep = min(1.0, items * FIT_ROWS / max(1, rows.count()))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable").reset_index(drop=True)
        x = _matrix(part)
        mine = [i for i in range(items) if i % parts == key[0] and (i // parts) % lanes == key[1]]
        return pd.DataFrame([r for i in mine for r in fn(i, part, x)], columns=names)

    dealt = rows.filter(F.pmod(F.xxhash64("row", F.lit("fit")), F.lit(1_000_000)) < int(keep * 1_000_000)) if keep < 1 else rows
    dealt = dealt.withColumn("part_", F.pmod(F.xxhash64("row", F.lit("part")), F.lit(parts)).cast("int")).withColumn("lane_", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return dealt.groupBy("part_", "lane_").applyInPandas(run, columns)


def grown(rows: DataFrame, specs: list[Spec], classes: list[int], seed: int = 0, share: float = 0.7, plain: bool = False) -> DataFrame:
    """spec, tree, model (a pickled tree) and gains of each tree of each forest."""
    items = [(s, k) for s, spec in enumerate(specs) for k in range(spec.trees)]
    known = np.array(classes)

    def one(item, part, x):
        s, k = items[item]
        spec = specs[s]
        train = np.arange(len(part)) if spec.split is None else np.flatnonzero(spec.split.train(part))
        if not len(train):
            return []
        rng = np.random.default_rng([seed, s, k])
        drawn = train[rng.integers(0, len(train), max(2, int(len(train) * (1.0 if plain else share))))]
        seen = x[drawn] if spec.columns is None else x[drawn][:, list(spec.columns)]
        tree = grow(seen, one_hot(part["y"].to_numpy()[drawn], known), rng, spec.depth, spec.subset)
        feature = np.array(tree.feature)
        gains = np.bincount(np.maximum(feature, 0), np.where(feature >= 0, tree.gain, 0.0), seen.shape[1])
        return [(s, k, pickle.dumps(tree), gains.tolist())]

    return per_tree(rows, len(items), one, "spec int, tree int, model binary, gains array<double>")


def label_values(rows: DataFrame) -> list[int]:
    """The labels, of which a classifier has few."""
    return sorted(r[0] for r in rows.select("y").distinct().collect())


def fit(rows: DataFrame, specs: list[Spec], seed: int = 0) -> dict[int, Forest]:
    """Forests by the place of their spec; those without training rows are missing."""
    classes = label_values(rows)
    out: dict[int, Forest] = {}
    # trees of bounded depth, as many as the specs ask for
    for r in sorted(grown(rows, specs, classes, seed).select("spec", "tree", "model").collect()):
        out.setdefault(r["spec"], Forest([], np.array(classes))).trees.append(pickle.loads(bytes(r["model"])))
    return out


def over_rows(rows: DataFrame, fn: Callable, columns: str) -> DataFrame:
    """Result rows of fn(chunk's number, its rows, their matrix) for chunks of all rows, dealt by hash."""
    ship(rows.sparkSession)
    chunks = max(1, math.ceil(rows.count() / CHUNK_ROWS))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable").reset_index(drop=True)
        return pd.DataFrame(fn(key[0], part, _matrix(part)), columns=names)

    return rows.withColumn("chunk_", F.pmod(F.xxhash64("row", F.lit("chunk")), F.lit(chunks)).cast("int")).groupBy("chunk_").applyInPandas(run, columns)


def _seen(spec: Spec, x: np.ndarray) -> np.ndarray:
    return x if spec.columns is None else x[:, list(spec.columns)]


def scores(rows: DataFrame, specs: list[Spec], forests: dict[int, Forest], scoring: str) -> DataFrame:
    """spec, score: mean accuracy or negative log loss over all rows that the spec's split tests."""
    if scoring not in ("accuracy", "neg_log_loss"):
        raise ValueError("scoring is accuracy or neg_log_loss")

    def one(_, part, x):
        y, out = part["y"].to_numpy(), []
        for s, forest in forests.items():
            at = np.flatnonzero(specs[s].split.test(part)) if specs[s].split else np.arange(len(part))
            if len(at):
                p = forest.probabilities(_seen(specs[s], x[at]))
                v = (forest.classes[p.argmax(1)] == y[at]).astype(float) if scoring == "accuracy" else -log_loss(y[at], p, forest.classes)
                out.append((s, len(at), float(v.sum())))
        return out

    r = over_rows(rows, one, "spec int, n long, s double")
    return r.groupBy("spec").agg((F.sum("s") / F.sum("n")).alias("score"))


def mean_decrease_impurity(rows: DataFrame, features: int, trees: int = 100, seed: int = 0) -> DataFrame:
    """feature, importance, error: gains per tree, zeros taken as missing, scaled to sum to 1."""
    g = grown(rows, [Spec(None, None, trees, 8, 1)], label_values(rows), seed, plain=True)
    per = g.select("tree", F.posexplode("gains").alias("feature", "gain"), F.aggregate("gains", F.lit(0.0), lambda a, b: a + b).alias("total"))
    m = per.filter("gain > 0").groupBy("feature").agg(F.avg(F.col("gain") / F.col("total")).alias("m"), F.stddev_samp(F.col("gain") / F.col("total")).alias("s"), F.count(F.lit(1)).alias("n"))
    total = m.agg(F.sum("m").alias("total"))
    every = rows.sparkSession.range(features).select(F.col("id").cast("int").alias("feature"))
    return every.join(m, "feature", "left").join(F.broadcast(total)).select("feature", F.coalesce(F.col("m") / F.col("total"), F.lit(0.0)).alias("importance"), (F.col("s") / F.sqrt("n") / F.col("total")).alias("error"))


def mean_decrease_accuracy(rows: DataFrame, features: int, k: int = 5, trees: int = 50, seed: int = 0, clusters: list[list[int]] | None = None) -> DataFrame:
    """feature (or cluster), importance, error: relative rise of test log loss when its columns are permuted."""
    groups = clusters or [[f] for f in range(features)]
    rows, splits = with_folds(rows, k, seed)
    specs = [Spec(s, None, trees) for s in splits]
    forests = fit(rows, specs, seed)

    def one(chunk, part, x):
        y, out = part["y"].to_numpy(), []
        for s, forest in forests.items():
            at = np.flatnonzero(specs[s].split.test(part))
            if not len(at):
                continue
            base = float(log_loss(y[at], forest.probabilities(x[at]), forest.classes).sum())
            for g, columns in enumerate(groups):
                z = x[at].copy()
                z[:, columns] = z[np.random.default_rng([seed, chunk, s, g]).permutation(len(z))][:, columns]
                out.append((s, g, len(at), base, float(log_loss(y[at], forest.probabilities(z), forest.classes).sum())))
        return out

    r = over_rows(rows, one, "fold int, feature int, n long, base double, worse double").groupBy("fold", "feature").agg(F.sum("base").alias("base"), F.sum("worse").alias("worse"))
    drop = r.select("feature", F.coalesce(F.try_divide(F.col("worse") - F.col("base"), F.col("worse")), F.lit(0.0)).alias("drop"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance"), (F.stddev_samp("drop") / math.sqrt(k)).alias("error"))


def clustered_impurity(mdi: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, importance: sums of mdi over clusters (feature, cluster)."""
    return mdi.join(clusters, "feature").groupBy("cluster").agg(F.sum("importance").alias("importance"))


def single_feature(rows: DataFrame, features: int, k: int = 5, trees: int = 30, scoring: str = "neg_log_loss", seed: int = 0) -> DataFrame:
    """feature, importance, error: cross-validated score of a forest on that feature alone."""
    rows, splits = with_folds(rows, k, seed)
    specs = [Spec(s, (f,), trees) for s in splits for f in range(features)]
    r = scores(rows, specs, fit(rows, specs, seed), scoring).withColumn("feature", (F.col("spec") % features).cast("int"))
    return r.groupBy("feature").agg(F.avg("score").alias("importance"), (F.stddev_samp("score") / math.sqrt(k)).alias("error"))


def _stump_blocks(tree, x: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Local decision stumps of a tree's inner nodes, and each feature's own values; the feature of each column.

    A stump is nonzero for the rows that reach its node and splits them so that its mean is zero.
    """
    columns, owner, reach = [], [], {0: np.ones(len(x), bool)}
    for node, f in enumerate(tree.feature):
        if f < 0:
            continue
        left = reach[node] & (x[:, f] <= tree.threshold[node])
        right = reach[node] & ~left
        reach[tree.left[node]], reach[tree.right[node]] = left, right
        a, b = left.sum(), right.sum()
        if a and b:
            columns.append((b * left.astype(float) - a * right) / math.sqrt(a * b))
            owner.append(f)
    for f in sorted(set(owner)):
        sd = x[:, f].std()
        columns.append((x[:, f] - x[:, f].mean()) / sd if sd else np.zeros(len(x)))
        owner.append(f)
    return np.array(columns).T.reshape(len(x), -1), np.array(owner, int)


def mdi_plus(rows: DataFrame, features: int, trees: int = 60, depth: int = 6, seed: int = 0, penalty: float = 1.0) -> DataFrame:
    """feature, importance: how well a feature's part of a penalised linear model on a tree's stumps and raw
    features predicts the labels of rows that are left out one at a time (mean R squared over classes and trees).

    Leaving a row out has a closed form for ridge regression, by the row's leverage.
    """
    classes = np.array(label_values(rows))

    def one(k, part, x):
        hot = one_hot(part["y"].to_numpy(), classes)
        rng = np.random.default_rng([seed, k])
        drawn = rng.integers(0, len(x), len(x))
        z, owner = _stump_blocks(grow(x[drawn], hot[drawn], rng, depth), x, features)
        spread = ((hot - hot.mean(0)) ** 2).sum(0)
        if not z.shape[1] or not (spread > 0).any():
            return [(-1, 0.0, k)]
        c = z - z.mean(0)
        solved = np.linalg.solve(c.T @ c + penalty * np.eye(c.shape[1]), c.T).T  # rows of the inverse times each sample
        target = hot - hot.mean(0)
        beta = solved.T @ target
        leverage = np.minimum((c * solved).sum(1) + 1 / len(c), 1 - 1e-9)
        residual = (target - c @ beta) / (1 - leverage)[:, None]
        out = [(-1, 0.0, k)]
        for f in np.unique(owner):
            at = owner == f
            part_of = c[:, at] @ beta[at] - (c[:, at] * solved[:, at]).sum(1)[:, None] * residual
            r2 = 1 - ((target - part_of) ** 2).sum(0)[spread > 0] / spread[spread > 0]
            out.append((int(f), float(r2.mean()), k))
        return out

    r = per_tree(rows, trees, one, "feature int, v double, k int")
    used = r.filter("feature = -1").agg(F.count(F.lit(1)).alias("used"))
    every = rows.sparkSession.range(features).select(F.col("id").cast("int").alias("feature"))
    s = r.filter("feature >= 0").groupBy("feature").agg(F.sum("v").alias("v"))
    return every.join(s, "feature", "left").join(F.broadcast(used)).select("feature", F.coalesce(F.try_divide("v", F.col("used")), F.lit(0.0)).alias("importance"))


def knockoff_law(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, C) of equicorrelated Gaussian knock-offs: mean + (x - mean) @ A + noise @ C."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = cov / np.outer(sd, sd)
    least = float(np.linalg.eigvalsh(corr)[0])
    s = np.eye(len(cov)) * min(1.0, 2 * max(least, 0.0)) * 0.999
    inverse_s = np.linalg.solve(corr + 1e-10 * np.eye(len(cov)), s)
    values, vectors = np.linalg.eigh(2 * s - s @ inverse_s)
    root = (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T
    return (np.eye(len(cov)) - inverse_s) / sd[:, None] * sd[None, :], root * sd[None, :]


def predictive_impact(rows: DataFrame, features: int, k: int = 4, trees: int = 80, depth: int = 6, seed: int = 0) -> DataFrame:
    """feature, importance, p_value: mean rise of each row's test loss when a feature is replaced by its
    Gaussian knock-off, and a one-sided paired t-test of it.

    Knock-offs have the covariance of the features, which all rows give, so they are drawn for all features
    at once and a feature's own is put in alone.
    """
    mean = np.array(rows.agg(F.array(*[F.avg(F.get("x", f)) for f in range(features)])).first()[0])
    drift, noise = knockoff_law(mean, to_numpy(covariance(rows, "x", features), features))
    rows, splits = with_folds(rows, k, seed)
    specs = [Spec(s, None, trees, depth) for s in splits]
    forests = fit(rows, specs, seed)

    def one(chunk, part, x):
        y, out = part["y"].to_numpy(), []
        other = mean + (x - mean) @ drift + np.random.default_rng([seed, chunk]).standard_normal(x.shape) @ noise
        for s, forest in forests.items():
            at = np.flatnonzero(specs[s].split.test(part))
            if not len(at):
                continue
            base = log_loss(y[at], forest.probabilities(x[at]), forest.classes)
            for f in range(features):
                z = x[at].copy()
                z[:, f] = other[at, f]
                rise = log_loss(y[at], forest.probabilities(z), forest.classes) - base
                out.append((f, len(at), float(rise.sum()), float((rise * rise).sum())))
        return out

    r = over_rows(rows, one, "feature int, n long, s double, q double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, s: pd.Series, q: pd.Series) -> pd.Series:
        mean = s / n
        sd = np.sqrt(np.maximum((q - n * mean**2) / np.maximum(n - 1, 1), 0))
        return pd.Series([1.0 if v < 1e-12 else t_sf(m / (v / math.sqrt(c)), c - 1) for m, v, c in zip(mean, sd, n)])

    return r.select("feature", (F.col("s") / F.col("n")).alias("importance"), p_value("n", "s", "q").alias("p_value"))


def weighted_tau(importance: np.ndarray, ranks: np.ndarray) -> float:
    """Weighted rank agreement of importance with 1 / rank, averaged over both orders of weights.

    A pair counts with the sum of both weights, 1 / place in that order.  Pairs in agreement and against it come from
    merge counting, n log n, and ties (which count for neither) from their groups.  Without a pair that both sides
    tell apart it isn't defined (nan).
    """
    x, y = np.asarray(importance, float), 1.0 / np.asarray(ranks, float)
    n = len(x)

    def agreement(w: np.ndarray, y: np.ndarray) -> float:
        # of equal x the greater y first, so that they don't count
        order = np.lexsort((-y, x))
        count, weight = sums_below(y[order], np.stack([np.ones(n), w[order]]))
        return float((weight + count * w[order]).sum())

    def untied(w: np.ndarray, v: np.ndarray) -> float:
        _, group, size = np.unique(v, return_inverse=True, return_counts=True)
        return float((n - 1) * w.sum() - ((size - 1) * np.bincount(group, w)).sum())

    def one(key: np.ndarray) -> float:
        w = np.empty(n)
        w[np.argsort(-key, kind="stable")] = 1.0 / np.arange(1, n + 1)
        scale = untied(w, x) * untied(w, y)
        return (agreement(w, y) - agreement(w, -y)) / math.sqrt(scale) if scale > 0 else math.nan

    return float((one(x) + one(y)) / 2)


def weighted_taus(scores: DataFrame, importance: str, rank: str, key: str) -> DataFrame:
    """key and tau: weighted_tau of each key's rows in order of their rank; rows with a null value are left out, and
    tau is null where it isn't defined."""
    known = scores.filter(F.col(key).isNotNull() & F.col(importance).isNotNull() & ~F.isnan(importance) & (F.col(rank) > 0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tau = weighted_tau(rows[importance].to_numpy(float), rows[rank].to_numpy(float))
        return scalars(tau=tau if math.isfinite(tau) else None)

    return per_series(known.select(key, importance, rank), key, [rank, importance], run, "tau double")


def test_dataset(spark: SparkSession, n: int = 1000, features: int = 10, informative: int = 4, redundant: int = 2, noise_sd: float = 0.0, seed: int = 1) -> DataFrame:
    """row_id, I_*, R_* (copies with noise) and N_* columns, and y from the informative ones."""
    cols = {f"I_{k}": F.randn(seed + k) for k in range(informative)} | {f"N_{k}": F.randn(seed + 100 + k) for k in range(features - informative - redundant)}
    d = spark.range(n, numPartitions=4).withColumnRenamed("id", "row_id").withColumns(cols)
    d = d.withColumns({f"R_{k}": F.col(f"I_{k % informative}") + noise_sd * F.randn(seed + 200 + k) for k in range(redundant)})
    return d.withColumn("y", (sum((F.col(f"I_{k}") for k in range(informative)), F.lit(0.0)) > 0).cast("int"))


# ---- scoring, search, bagging ----------------------------------------------------------------------


def purge(starts: np.ndarray, ends: np.ndarray, test: np.ndarray, embargo: float = 0.0) -> np.ndarray:
    """Training positions that don't overlap one contiguous test block."""
    lo, hi = starts[test].min(), ends[test[np.argmax(starts[test])]]
    step = int(len(starts) * embargo)
    if step:
        at = int(np.searchsorted(starts, hi))
        hi = starts[min(at + step, len(starts) - 1)] if at < len(starts) else hi
    clear = ~((starts <= hi) & (ends >= lo))
    clear[test] = False
    return np.flatnonzero(clear)


def cross_val_score(rows: DataFrame, splits: list[Split], scoring: str = "accuracy", trees: int = 50, depth: int = 6, seed: int = 0) -> DataFrame:
    """split_id, score of the splits that have training and test rows."""
    specs = [Spec(s, None, trees, depth) for s in splits]
    return scores(rows, specs, fit(rows, specs, seed), scoring).select(F.col("spec").alias("split_id"), "score")


def search(rows: DataFrame, candidates: list[dict], splits: list[Split], seed: int = 0) -> tuple[dict, DataFrame, Forest]:
    """(best parameters, scores by candidate, model refitted on all rows)."""
    unknown = {k for c in candidates for k in c} - {"n_trees", "max_depth", "n_subfeatures"}
    if unknown:
        raise ValueError(f"no such parameters: {', '.join(sorted(unknown))}")
    spec = lambda c, s: Spec(s, None, c.get("n_trees", 50), c.get("max_depth", 6), c.get("n_subfeatures"))
    specs = [spec(c, s) for c in candidates for s in splits]
    found = scores(rows, specs, fit(rows, specs, seed), "accuracy").withColumn("candidate", F.floor(F.col("spec") / len(splits)).cast("int"))
    found = found.groupBy("candidate").agg(F.avg("score").alias("score"))
    best = candidates[found.orderBy(F.desc("score"), "candidate").first()["candidate"]]
    return best, found, fit(rows, [spec(best, None)], seed)[0]


def parameter_grid(grid: dict) -> list[dict]:
    return [dict(zip(grid, v)) for v in itertools.product(*grid.values())]


def random_candidates(grid: dict, n: int, seed: int = 0) -> list[dict]:
    every = parameter_grid(grid)
    return [every[k] for k in np.random.default_rng(seed).permutation(len(every))[:n]]


def leakage_aware_search(rows: DataFrame, grid: dict, trials: int = 10, k: int = 4, embargo: float = 0.01, seed: int = 0) -> dict:
    """Random search over purged and embargoed folds; rows may have start and end."""
    rows, splits = contiguous_splits(rows, k, embargo)
    best, found, model = search(rows, random_candidates(grid, trials, seed), splits, seed)
    s = [r["score"] for r in found.orderBy("candidate").collect()]  # one a trial
    return {"best_params": best, "best_score": max(s), "trial_scores": s, "mean_trial_score": float(np.mean(s)), "std_trial_score": float(np.std(s)), "n_trials": trials, "model": model}


def bagging_accuracy(n: int, p: float) -> float:
    """Chance that more than half of an odd number of independent votes are right."""
    if n % 2 == 0:
        raise ValueError("the number of votes is odd")
    from ..functions.special import binom_pmf

    return sum(binom_pmf(k, n, p) for k in range(n // 2 + 1, n + 1))


def bagging_votes(train: DataFrame, other: DataFrame, trees: int = 1000, draw: int = 100, uniqueness: str | None = None, seed: int = 0) -> DataFrame:
    """row, y, right and wrong by scheme: sums of the weights of the trees that vote for the greater and the
    lesser label on each row of `other`; two labels.

    Each tree is grown from `draw` samples with one feature a split, drawn by the column `uniqueness` if that
    is given.  Schemes: uniform, accuracy (a tree's share of right votes over all training rows) and variance
    (1 - accuracy squared).
    """
    classes = label_values(train)
    if len(classes) != 2:
        raise ValueError("two classes are needed")
    known = np.array(classes)

    def one(k, part, x):
        rng = np.random.default_rng([seed, k])
        p = None if uniqueness is None else part[uniqueness].to_numpy(float) / part[uniqueness].sum()
        drawn = rng.choice(len(part), min(draw, len(part)), p=p)
        return [(k, pickle.dumps(grow(x[drawn], one_hot(part["y"].to_numpy()[drawn], known), rng, 64, 1)))]

    models = sorted((r["tree"], bytes(r["model"])) for r in per_tree(train, trees, one, "tree int, model binary").collect())
    models = [m for _, m in models]

    def right(_, part, x):
        y = part["y"].to_numpy()
        return [(k, len(y), int((known[pickle.loads(m).predict(x).argmax(1)] == y).sum())) for k, m in enumerate(models)]

    counted = {r["tree"]: r["s"] / r["n"] for r in over_rows(train, right, "tree int, n long, s long").groupBy("tree").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    accuracy = np.array([counted[k] for k in range(len(models))])
    weights = np.array([np.ones(len(models)), accuracy, 1 - accuracy**2])
    weights /= np.where(weights.sum(1, keepdims=True) > 0, weights.sum(1, keepdims=True), 1)

    def vote(_, part, x):
        signs = np.array([np.where(pickle.loads(m).predict(x).argmax(1) == 1, 1.0, -1.0) for m in models])
        return [(int(r), int(y), *map(float, v)) for r, y, v in zip(part["row"], part["y"], (weights @ signs).T)]

    return over_rows(other, vote, "row long, y int, uniform double, accuracy double, variance double")


def scheme_accuracy(votes: DataFrame, classes: tuple[int, int] = (0, 1)) -> DataFrame:
    """scheme, n, accuracy of the votes' signs."""
    long_ = votes.select("y", F.explode(F.create_map(*[x for c in ("uniform", "accuracy", "variance") for x in (F.lit(c), F.col(c))])).alias("scheme", "vote"))
    return long_.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.avg((F.when(F.col("vote") > 0, classes[1]).otherwise(classes[0]) == F.col("y")).cast("double")).alias("accuracy"))


def bootstrap_accuracy(n: int, accuracy: float, draws: int = 1000, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """(values, mean, deviation) of the accuracy over resampled test rows: how many of n rows drawn with
    replacement are rightly classified has a binomial law, so no row is drawn."""
    values = np.random.default_rng(seed).binomial(n, accuracy, draws) / n
    return values, float(values.mean()), float(values.std(ddof=1))
