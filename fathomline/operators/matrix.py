"""Covariance by distributed sums, then denoising, clustering and allocation of the small matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise, ship

# ---- long-form matrices ----------------------------------------------------------------------------


def covariance(rows: DataFrame, values: str, dims: int) -> DataFrame:
    """i, j, v (1-based): sample covariance of an array column.

    Each task adds up its own matrix of products about the mean of its first rows, by matrix products over
    Arrow batches; the shuffle carries dims^2 sums a task and no rows, and tasks' sums are then moved to
    the common mean.
    """
    ship(rows.sparkSession)

    def run(batches):
        n, centre, total, gram = 0, None, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dims)
            centre = x.mean(0) if centre is None else centre
            x = x - centre
            n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        if n:
            mean = centre + total / n
            about = gram - np.outer(total, total) / n
            at = np.arange(dims)
            i, j = np.repeat(at, dims), np.tile(at, dims)
            columns = [np.full(dims * dims, n), i + 1, j + 1, about.ravel(), mean[i], mean[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], ["n", "i", "j", "s", "mi", "mj"])

    parts = rows.select(values).mapInArrow(run, "n long, i int, j int, s double, mi double, mj double")
    # sums about the tasks' means, and of the tasks' means about the common one
    w = F.col("n") * F.col("mi")
    g = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(w * F.col("mj")).alias("mm"), F.sum(w).alias("mi"), F.sum(F.col("n") * F.col("mj")).alias("mj"))
    return g.select("i", "j", F.try_divide(F.col("s") + F.col("mm") - F.col("mi") * F.col("mj") / F.col("n"), F.col("n") - 1).alias("v"))


def correlation(cov: DataFrame) -> DataFrame:
    """i, j, v: clamped, with a unit diagonal; a zero deviation counts as 1."""
    d = cov.filter("i = j").select(F.col("i").alias("k"), F.when(F.col("v") > 0, F.sqrt("v")).otherwise(F.lit(1.0)).alias("s"))
    a, b = d.select(F.col("k").alias("i"), F.col("s").alias("si")), d.select(F.col("k").alias("j"), F.col("s").alias("sj"))
    r = F.greatest(F.least(F.try_divide("v", F.col("si") * F.col("sj")), F.lit(1.0)), F.lit(-1.0))
    return cov.join(a, "i").join(b, "j").select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(r).alias("v"))


def inverse_variance(cov: DataFrame) -> DataFrame:
    d = cov.filter("i = j").select(F.col("i").alias("asset"), F.try_divide(F.lit(1.0), F.col("v")).alias("w"))
    total = d.agg(F.sum("w").alias("total"))
    return d.join(F.broadcast(total)).select("asset", (F.col("w") / F.col("total")).alias("weight"))


def silhouette(distance: DataFrame, labels: DataFrame) -> DataFrame:
    """item, silhouette; 0 for an item alone in its cluster."""
    li, lj = labels.select(F.col("item").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("item").alias("j"), F.col("cluster").alias("cj"))
    m = distance.join(li, "i").join(lj, "j").filter("i <> j").groupBy("i", "ci", "cj").agg(F.avg("v").alias("d"))
    s = m.groupBy("i").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return s.select(F.col("i").alias("item"), F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(score).alias("silhouette"))


def block_matrix(spark: SparkSession, blocks: int, size: int, rho: float) -> DataFrame:
    """i, j, v: rho within blocks, 1 on the diagonal, 0 elsewhere."""
    n = blocks * size
    r = spark.range(1, n + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("j"))
    same = F.floor((F.col("i") - 1) / size) == F.floor((F.col("j") - 1) / size)
    return r.withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).when(same, F.lit(float(rho))).otherwise(0.0))


def to_numpy(m: DataFrame, n: int) -> np.ndarray:
    """A small matrix on the driver; n x n is its bound."""
    out = np.zeros((n, n))
    for i, j, v in m.select("i", "j", "v").collect():
        out[i - 1, j - 1] = v
    return out


def from_numpy(spark: SparkSession, m: np.ndarray) -> DataFrame:
    n = len(m)
    return spark.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(1, n + 1), m.shape[1]), "j": np.tile(np.arange(1, m.shape[1] + 1), n), "v": m.ravel()}))


# ---- random-matrix denoising -----------------------------------------------------------------------


def marcenko_pastur(var: float, q: float, points: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = var * (1 - q**-0.5) ** 2, var * (1 + q**-0.5) ** 2
    x = np.linspace(lo, hi, points)
    return x, q / (2 * np.pi * var * x) * np.sqrt(np.maximum((hi - x) * (x - lo), 0))


def marcenko_pastur_rows(spark: SparkSession, var: float, q: float, points: int) -> DataFrame:
    lo, hi = var * (1 - q**-0.5) ** 2, var * (1 + q**-0.5) ** 2
    x = lo + (hi - lo) * F.col("id") / (points - 1)
    return spark.range(points).select("id", x.alias("x")).withColumn("pdf", q / (2 * math.pi * var * F.col("x")) * F.sqrt(F.greatest((hi - F.col("x")) * (F.col("x") - lo), F.lit(0.0))))


def pca(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, greatest first, and vectors."""
    w, v = np.linalg.eigh(m)
    return w[::-1], v[:, ::-1]


def cov_to_corr(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    s = np.where(s == 0, 1.0, s)
    r = np.clip(cov / np.outer(s, s), -1, 1)
    np.fill_diagonal(r, 1.0)
    return r


def corr_to_cov(corr: np.ndarray, s: np.ndarray) -> np.ndarray:
    return corr * np.outer(s, s)


def denoised_corr(values: np.ndarray, vectors: np.ndarray, facts: int) -> np.ndarray:
    """Eigenvalues beyond the facts are replaced by their mean; unit diagonal again."""
    v = values.copy()
    if facts < len(v):
        v[facts:] = v[facts:].mean()
    return cov_to_corr(vectors @ np.diag(v) @ vectors.T)


def fit_noise(values: np.ndarray, q: float, bandwidth: float) -> tuple[float, float]:
    """(upper edge, variance) of the noise density closest to a kernel density of the eigenvalues."""

    def miss(var: float) -> float:
        x, pdf = marcenko_pastur(var, q, len(values))
        seen = np.exp(-0.5 * ((x[:, None] - values) / bandwidth) ** 2).sum(1) / (len(values) * bandwidth * math.sqrt(2 * math.pi))
        return float(((seen - pdf) ** 2).sum())

    ratio, lo, hi = (math.sqrt(5) - 1) / 2, 1e-5, 1 - 1e-5
    while hi - lo > 1e-6:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if miss(a) < miss(b) else (a, hi)
    var = (lo + hi) / 2
    return var * (1 + q**-0.5) ** 2, var


def denoise_cov(cov: np.ndarray, q: float, bandwidth: float = 0.01) -> np.ndarray:
    values, vectors = pca(cov_to_corr(cov))
    edge, _ = fit_noise(values, q, bandwidth)
    return corr_to_cov(denoised_corr(values, vectors, int((values > edge).sum())), np.sqrt(np.diag(cov)))


def optimal_portfolio(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    w = np.linalg.solve(cov, np.ones(len(cov)) if mu is None else np.asarray(mu, float))
    return w / w.sum()


def optimal_portfolio_denoised(cov: np.ndarray, q: float, mu=None, bandwidth: float = 0.01) -> np.ndarray:
    return optimal_portfolio(denoise_cov(cov, q, bandwidth), mu)


def positive_definite(m: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    w = np.maximum(w, max(eps, eps * w.max(initial=0)))
    out = v @ np.diag(w) @ v.T
    return (out + out.T) / 2


def split_estimate(z: np.ndarray, m: int, rng: np.random.Generator) -> np.ndarray:
    """Eigenvectors of one part with the other part's variances along them."""
    order = rng.permutation(len(z))
    _, v = np.linalg.eigh(np.cov(z[order[:m]].T))
    d = np.einsum("ij,ik,kj->j", v, np.cov(z[order[m:]].T), v)
    return v @ np.diag(d) @ v.T


def nercome(returns: np.ndarray, splits: int = 50, share: float = 2 / 3, seed: int = 0) -> np.ndarray:
    n, p = returns.shape
    if n < 4:
        raise ValueError("at least 4 observations are needed")
    s = returns.std(0, ddof=1)
    s = np.where(s <= 0, 1.0, s)
    z = returns / s
    m = min(max(p + 1, round(share * n)), n - 2)
    total = sum(split_estimate(z, m, np.random.default_rng([seed, k])) for k in range(splits)) / splits
    return positive_definite(corr_to_cov(total, s))


def nercome_rows(spark: SparkSession, returns: np.ndarray, splits: int = 50, share: float = 2 / 3, seed: int = 0) -> DataFrame:
    """i, j, v: the same with splits as rows, averaged by Spark."""
    ship(spark)
    n, p = returns.shape
    s = np.where(returns.std(0, ddof=1) <= 0, 1.0, returns.std(0, ddof=1))
    z, m = returns / s, min(max(p + 1, round(share * n)), n - 2)

    def run(batches):
        for b in batches:
            for k in b["id"]:
                e = corr_to_cov(split_estimate(z, m, np.random.default_rng([seed, int(k)])), s)
                yield pd.DataFrame({"i": np.repeat(np.arange(1, p + 1), p), "j": np.tile(np.arange(1, p + 1), p), "v": e.ravel()})

    return spark.range(splits).repartition(min(splits, 32)).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.avg("v").alias("v"))


# ---- clustering ------------------------------------------------------------------------------------


def corr_distance(corr: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1 - np.nan_to_num(corr), 0) / 2)


def silhouette_samples(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    n = len(labels)
    own = labels[:, None] == labels[None, :]
    np.fill_diagonal(own, False)
    out = np.zeros(n)
    for i in range(n):
        if own[i].any():
            a = d[i, own[i]].mean()
            b = min((d[i, labels == c].mean() for c in set(labels) - {labels[i]}), default=0.0)
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Labels by Lloyd's rounds from spread-out seeds."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]])
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        if (new == labels).all() and _:
            break
        labels = new
        centres = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
    return labels


def best_clustering(corr: np.ndarray, most: int = 10, tries: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, silhouettes) with the greatest mean over deviation of silhouettes."""
    d = corr_distance(corr)
    best = None
    for t in range(tries):
        for k in range(2, min(most, len(corr)) + 1):
            labels = np.unique(k_means(d, k, np.random.default_rng([seed, t, k])), return_inverse=True)[1]
            s = silhouette_samples(d, labels)
            score = s.mean() / s.std() if s.std() > 0 else -np.inf
            if best is None or score > best[0]:
                best = (score, labels, s)
    return best[1], best[2]


def cluster_quality(s: np.ndarray, labels: np.ndarray) -> dict[int, float]:
    sd = {c: s[labels == c].std(ddof=1) if (labels == c).sum() > 1 else 0.0 for c in np.unique(labels)}
    return {c: float(s[labels == c].mean() / v) for c, v in sd.items() if v > 0}


def _numbered(labels) -> np.ndarray:
    """The same clusters as 0, 1, ..."""
    return np.unique(labels, return_inverse=True)[1]


def optimal_clusters(corr: np.ndarray, most: int | None = None, tries: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, silhouettes) of the optimal number of clusters: top-level clusters whose quality is below the
    average are clustered anew among themselves for as long as that raises their mean quality.

    A loop: `sets` holds the items that are still looked at together.  Of a set's clusters the good ones are
    settled; the weak ones are the next, smaller set.  The settlings are then tried from the innermost outwards,
    and each is taken where the weak items' mean quality, with all items in place, is higher with it.
    """
    n = len(corr)
    if n < 3 or (most is not None and most < 2):
        return np.zeros(n, int), np.zeros(n)
    distance, found, items = corr_distance(corr), [], np.arange(n)
    while len(items) > 2:
        labels, s = best_clustering(corr[np.ix_(items, items)], min(most or n, len(items) - 1), tries, seed)
        quality = cluster_quality(s, labels)
        average = sum(quality.values()) / max(len(quality), 1)
        weak = np.isin(labels, [c for c, q in quality.items() if q < average])
        found.append((items, labels, weak))
        if len(set(labels[weak])) < 2 or weak.all():
            break
        items = items[weak]
    inner: np.ndarray | None = None
    for items, labels, weak in reversed(found):
        if inner is not None:
            part = distance[np.ix_(items, items)]
            split = labels.copy()
            split[weak] = labels.max() + 1 + inner
            mean = lambda of: np.mean([q for c, q in cluster_quality(silhouette_samples(part, of), of).items() if c in set(of[weak])] or [-np.inf])  # noqa: B023, E731
            labels = split if mean(split) > mean(labels) else labels
        inner = _numbered(labels)
    return inner, silhouette_samples(distance, inner)


def random_block_covariance(n: int, blocks: int, least: int = 1, sigma: float = 1.0, seed: int = 0) -> np.ndarray:
    """Covariances of noisy copies of one series per block."""
    rng = np.random.default_rng(seed)
    extra = rng.multinomial(n - least * blocks, np.full(blocks, 1 / blocks)) + least
    out = np.zeros((n, n))
    at = 0
    for size in extra:
        base = rng.standard_normal((size * 20 + 50, 1))
        x = base + sigma * rng.standard_normal((len(base), size))
        out[at : at + size, at : at + size] = np.cov(x.T).reshape(size, size)
        at += size
    return out


def random_block_correlation(n: int, blocks: int, least: int = 1, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed + 1)
    noise = rng.standard_normal((n, 5 * n))
    return cov_to_corr(random_block_covariance(n, blocks, least, 0.5, seed) + np.cov(noise) * 0.1)


# ---- allocation ------------------------------------------------------------------------------------


def inverse_variance_weights(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def cluster_variance(cov: np.ndarray, items: np.ndarray) -> float:
    part = cov[np.ix_(items, items)]
    w = inverse_variance_weights(part)
    return float(w @ part @ w)


def spanning_tree(distance: DataFrame) -> list[tuple[float, int, int]]:
    """The least edges (v, i, j), i < j, that join all items of a long distance table: one fewer than items.

    Boruvka's rounds: each component's least edge leaving it, a minimum per component over the table, joins it to
    another; components at least halve in a round.  Of equal distances the least (i, j) counts as shorter.  Only a row
    per item comes to the driver in a round.  Items that no edge reaches stay apart.
    """
    spark = distance.sparkSession
    edges = materialise(distance.filter("i < j AND v IS NOT NULL AND NOT isnan(v)").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v"), "edges")
    up = {r[0]: r[0] for r in edges.select("i").union(edges.select("j")).distinct().collect()}
    tree: set[tuple[float, int, int]] = set()

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    while len(up) > 1:
        parts = spark.createDataFrame([(k, root(k)) for k in up], "item int, part int")
        ends = edges.join(parts.select(F.col("item").alias("i"), F.col("part").alias("pi")), "i").join(parts.select(F.col("item").alias("j"), F.col("part").alias("pj")), "j").filter("pi <> pj")
        least = ends.select(F.explode(F.array("pi", "pj")).alias("part"), F.struct("v", "i", "j").alias("e")).groupBy("part").agg(F.min("e").alias("e")).collect()
        if not least:
            break
        for r in least:
            v, i, j = r["e"]
            tree.add((v, i, j))
            up[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(tree)


def matrix_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """The same tree of a matrix (items from 0): grown from item 0 by the least edge, in steps of whole rows."""
    n = len(d)
    gap, origin, out = d[0].astype(float).copy(), np.zeros(n, int), np.zeros(n, bool)
    out[0] = True
    tree = []
    for _ in range(n - 1):
        gap[out] = np.inf
        ties = np.flatnonzero(gap == gap.min())
        k = min(ties, key=lambda t: (min(t, origin[t]), max(t, origin[t])))
        tree.append((float(gap[k]), int(min(k, origin[k])), int(max(k, origin[k]))))
        out[k] = True
        j = np.arange(n)
        pair = lambda a: np.minimum(a, j) * n + np.maximum(a, j)
        nearer = ~out & ((d[k] < gap) | ((d[k] == gap) & (pair(np.full(n, k)) < pair(origin))))
        gap[nearer], origin[nearer] = d[k][nearer], k
    return sorted(tree)


def linkage(tree: list[tuple[float, int, int]], n: int) -> np.ndarray:
    """Rows (a, b, distance, size) of a spanning tree's n items, from 0: clusters merge along its edges, shortest first
    and of equals by (i, j); a new cluster's number follows those before it, and a < b."""
    up, number, size = list(range(n)), list(range(n)), [1] * n

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    link = []
    for v, i, j in sorted(tree):
        a, b = root(i), root(j)
        link.append((min(number[a], number[b]), max(number[a], number[b]), v, size[a] + size[b]))
        up[b], number[a], size[a] = a, n + len(link) - 1, size[a] + size[b]
    return np.array(link)


def single_linkage(d: np.ndarray) -> np.ndarray:
    """Linkage rows of a distance matrix."""
    return linkage(matrix_tree(d), len(d))


def quasi_diagonal(link: np.ndarray) -> list[int]:
    """Leaves in the tree's order, 1-based."""
    n = len(link) + 1
    out, todo = [], [2 * n - 2]
    while todo:
        k = todo.pop()
        if k < n:
            out.append(k + 1)
        else:
            todo += [int(link[k - n, 1]), int(link[k - n, 0])]
    return out


def recursive_bisection(cov: np.ndarray, order: list[int]) -> np.ndarray:
    """Weights in the given order (1-based): halves share their parent's weight by inverse variance."""
    weight = dict.fromkeys(order, 1.0)
    todo = [list(order)]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        half = [part[: len(part) // 2], part[len(part) // 2 :]]
        v = [cluster_variance(cov, np.array(h) - 1) for h in half]
        for h, share in zip(half, (1 - v[0] / sum(v), v[0] / sum(v))):
            for k in h:
                weight[k] *= share
        todo += half
    return np.array([weight[k] for k in order])


def hierarchical_risk_parity(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    return _parity(cov, single_linkage(corr_distance((corr + corr.T) / 2)))


def _parity(cov: np.ndarray, link: np.ndarray) -> np.ndarray:
    order = quasi_diagonal(link)
    out = np.empty(len(cov))
    out[np.array(order) - 1] = recursive_bisection(cov, order)
    return out


def distances(cov: DataFrame) -> DataFrame:
    """i, j, v: sqrt((1 - r) / 2) of the correlations of a long covariance table."""
    return correlation(cov).select("i", "j", F.sqrt(F.greatest((1 - F.col("v")) / 2, F.lit(0.0))).alias("v"))


def hierarchical_weights(cov: DataFrame, n: int) -> np.ndarray:
    """Hierarchical risk parity of a long covariance table of items 1 to n: the tree is found over the distributed
    distances, and the matrix itself, n x n, serves the bisection on the driver."""
    tree = spanning_tree(distances(cov))
    matrix = to_numpy(cov, n)
    return _parity(matrix, linkage([(v, i - 1, j - 1) for v, i, j in tree], len(matrix)))


def pca_weights(cov: np.ndarray, risk: np.ndarray | None = None, target: float = 1.0) -> np.ndarray:
    """Weights whose risk is spread over components as asked, all on the last one by default."""
    w, v = pca(cov)
    share = np.eye(len(w))[-1] if risk is None else np.asarray(risk, float)
    return v @ (target * np.sqrt(share / w))


def nested_clustered(cov: np.ndarray, mu: np.ndarray | None = None, clusters: int | None = None, seed: int = 0) -> np.ndarray:
    labels, _ = best_clustering(cov_to_corr(cov), clusters or max(len(cov) // 2, 2), 10, seed)
    inner = np.zeros((len(cov), labels.max() + 1))
    for c in range(labels.max() + 1):
        k = labels == c
        inner[k, c] = optimal_portfolio(cov[np.ix_(k, k)], None if mu is None else np.asarray(mu)[k])
    return inner @ optimal_portfolio(inner.T @ cov @ inner, None if mu is None else inner.T @ np.asarray(mu))


def orthogonal_features(x: np.ndarray, threshold: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(components, eigenvalues, vectors, cumulative share) of the standardised features, as many as reach the threshold."""
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, v = pca(z.T @ z)
    share = np.cumsum(w) / w.sum()
    k = int(np.searchsorted(share, threshold - 1e-12)) + 1
    return z @ v[:, :k], w[:k], v[:, :k], share[:k]


def orthogonal_rows(rows: DataFrame, values: str, dims: int, threshold: float = 0.95) -> DataFrame:
    """rows with `components`: the standardised values of an array column projected on as many eigenvectors of their
    products as reach the threshold.

    Means, deviations and products come from one distributed covariance; only the dims x dims matrix is decomposed
    on the driver, and every row is projected where it lies.  A value without deviation counts 0; a row whose
    array is null, or holds null, has null components.
    """
    ship(rows.sparkSession)
    full = F.when(F.size(values) == dims, F.col(values)).cast("array<double>")
    full = F.when(~F.exists(full, lambda x: x.isNull() | F.isnan(x)), full)
    taken = rows.withColumn("_values", full)
    known = taken.filter(F.col("_values").isNotNull())
    sums = known.select(F.posexplode("_values").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n")).collect()  # dims rows
    if not sums:
        return taken.drop("_values").withColumn("components", F.lit(None).cast("array<double>"))
    mean, sd = np.zeros(dims), np.ones(dims)
    for r in sums:
        mean[r["k"]], sd[r["k"]] = r["mean"], r["sd"] or np.inf
    cov = to_numpy(covariance(known, "_values", dims), dims)
    w, v = pca(cov / np.outer(sd, sd) * (sums[0]["n"] - 1))
    share = np.cumsum(w) / w.sum()
    v = v[:, : min(int(np.searchsorted(share, threshold - 1e-12)) + 1, dims)]

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index("_values"))
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)
            z = ((x - mean) / sd) @ v
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.is_valid()) * v.shape[1])]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()), mask=column.is_null())
            rest = [c for c in b.schema.names if c != "_values"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), own], [*rest, "components"])

    schema = T.StructType([*rows.schema.fields, T.StructField("components", T.ArrayType(T.DoubleType()))])
    return taken.mapInArrow(run, schema)


def hrp_monte_carlo(spark: SparkSession, trials: int, assets: int = 10, steps: int = 260, window: int = 130, seed: int = 1) -> DataFrame:
    """method, mean variance out of sample over random markets; a trial is a row."""
    ship(spark)

    def run(batches):
        for b in batches:
            rows = []
            for k in b["id"]:
                rng = np.random.default_rng([seed, int(k)])
                x = rng.standard_normal((steps, assets))
                x[:, assets // 2 :] = x[:, rng.integers(0, assets // 2, assets - assets // 2)] + 0.25 * x[:, assets // 2 :]
                cov = np.cov(x[:window].T)
                for name, w in (("hrp", hierarchical_risk_parity(cov, cov_to_corr(cov))), ("gmv", optimal_portfolio(cov)), ("ivp", inverse_variance_weights(cov))):
                    rows.append((name, float((x[window:] @ w).var())))
            yield pd.DataFrame(rows, columns=["method", "variance"])

    return spark.range(trials).repartition(min(trials, 32)).mapInPandas(run, "method string, variance double").groupBy("method").agg(F.avg("variance").alias("variance"))
