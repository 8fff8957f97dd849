"""Cross-validation splits, backtest overfitting and regime-aware variants, as joins and aggregations.

Positions, folds and paths are 1-based.  Split tables are small: their size is set by the number of
groups, C(groups, chosen), and not by the data, so they are broadcast.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .backtest import expected_max, probabilistic_sharpe_ratio, psr_sql, sharpe


def folds(rows: DataFrame, k: int, order: str = "pos", key: str | None = None) -> DataFrame:
    """rows with fold 1..k: contiguous, the first ones a row longer where it doesn't divide."""
    w = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    return rows.withColumn("fold", F.ntile(k).over(w.orderBy(order)))


def k_fold(rows: DataFrame, k: int, seed: int | None = None, key: str = "symbol") -> DataFrame:
    """key, split_id, pos, role; with a seed positions are shuffled by hash before they are cut."""
    r = rows.select(key, "pos") if seed is None else rows.select(key, "pos").withColumn("_o", F.xxhash64(F.lit(seed), "pos"))
    f = folds(r, k, "pos" if seed is None else "_o", key)
    s = f.withColumn("split_id", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return s.select(key, "split_id", "pos", F.when(F.col("fold") == F.col("split_id"), "test").otherwise("train").alias("role"))


def walk_forward(rows: DataFrame, k: int, gap: int = 0, most: int | None = None, key: str = "symbol") -> DataFrame:
    f = folds(rows.select(key, "pos"), k, "pos", key)
    starts = f.groupBy(key, F.col("fold").alias("split_id")).agg(F.min("pos").alias("first"))
    j = f.join(starts, key).withColumn("end", F.col("first") - 1 - gap)
    train = F.col("pos") <= F.col("end")
    if most is not None:
        train = train & (F.col("pos") > F.col("end") - most)
    role = F.when(F.col("fold") == F.col("split_id"), F.lit("test")).when(train, F.lit("train"))
    return j.withColumn("role", role).filter(F.col("role").isNotNull()).select(key, "split_id", "pos", "role")


def _blocks(test: DataFrame, key: str, merge: bool) -> DataFrame:
    """key, split_id, lo, hi of the test rows' information; apart where starts leave a gap, if merge."""
    if not merge:
        return test.groupBy(key, "split_id").agg(F.min("start").alias("lo"), F.max_by("end", F.struct("start", "pos")).alias("hi"))
    w = Window.partitionBy(key, "split_id").orderBy("start", "pos")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = test.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    t = t.withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(key, "split_id", "_b").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).drop("_b")


def purged(rows: DataFrame, tests: DataFrame, embargo: float = 0.0, merge: bool = False, key: str = "symbol") -> DataFrame:
    """key, split_id, pos, role.  rows: key, pos, start, end; tests: key, split_id, pos.

    Training rows whose information overlaps a test block are left out, by an anti join on
    start <= hi and end >= lo; the embargo moves a block's end over so many further starts.
    """
    info = rows.select(key, "pos", "start", "end")
    test = tests.join(info, [key, "pos"])
    blocks = _blocks(test, key, merge)
    if embargo:
        n = info.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        earlier = info.select(F.col(key), F.col("start").alias("s"))
        blocks = blocks.withColumn("_id", F.xxhash64("split_id", "lo", "hi"))
        at = blocks.join(earlier, key).filter(F.col("s") < F.col("hi")).groupBy(key, "_id").agg(F.count(F.lit(1)).alias("at"))
        blocks = blocks.join(at, [key, "_id"], "left").join(n, key).withColumn("at", F.coalesce("at", F.lit(0))).withColumn("_go", F.least(F.col("at") + F.floor(F.col("n") * embargo), F.col("n") - 1) + 1)
        nth = info.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("_go"), F.col("start").alias("moved"))
        moves = (F.col("at") < F.col("n")) & (F.floor(F.col("n") * embargo) > 0)
        blocks = blocks.join(nth, [key, "_go"], "left").withColumn("hi", F.when(moves, F.col("moved")).otherwise(F.col("hi"))).select(key, "split_id", "lo", "hi")
    splits = tests.select(key, "split_id").distinct()
    all_rows = splits.join(info, key)
    b = blocks.select(F.col(key).alias("_k"), F.col("split_id").alias("_s"), "lo", "hi")
    clear = all_rows.join(b, (F.col(key) == F.col("_k")) & (F.col("split_id") == F.col("_s")) & (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")), "left_anti")
    train = clear.join(tests, [key, "split_id", "pos"], "left_anti")
    return train.select(key, "split_id", "pos", F.lit("train").alias("role")).unionByName(tests.select(key, "split_id", "pos", F.lit("test").alias("role")))


def purged_k_fold(rows: DataFrame, k: int, embargo: float = 0.0, key: str = "symbol") -> DataFrame:
    tests = folds(rows, k, "pos", key).select(key, F.col("fold").alias("split_id"), "pos")
    return purged(rows, tests, embargo, False, key)


def combination_table(spark: SparkSession, groups: int, chosen: int) -> DataFrame:
    """split_id, fold, path_id: the chosen groups of each combination and the path each walks."""
    if chosen >= groups:
        raise ValueError("fewer test groups than groups are needed")
    seen, rows = dict.fromkeys(range(1, groups + 1), 0), []
    for j, c in enumerate(combinations(range(1, groups + 1), chosen), 1):
        for g in c:
            seen[g] += 1
            rows.append((j, g, seen[g]))
    return spark.createDataFrame(rows, "split_id int, fold int, path_id int")


def combinatorial_purged(rows: DataFrame, groups: int, chosen: int, embargo: float = 0.0, key: str = "symbol") -> DataFrame:
    combos = combination_table(rows.sparkSession, groups, chosen)
    tests = folds(rows, groups, "pos", key).join(F.broadcast(combos), "fold").select(key, "split_id", "pos")
    return purged(rows, tests, embargo, True, key)


def backtest_paths(rows: DataFrame, groups: int, chosen: int, key: str = "symbol") -> DataFrame:
    """key, path_id, fold, split_id, pos: the test rows each path walks and the split that predicts them."""
    combos = combination_table(rows.sparkSession, groups, chosen)
    return folds(rows, groups, "pos", key).join(F.broadcast(combos), "fold").select(key, "path_id", "fold", "split_id", "pos")


# ---- probability of backtest overfitting -----------------------------------------------------------


def half_splits(spark: SparkSession, parts: int) -> DataFrame:
    """split_id, part, is_train for all choices of half of the parts, numbered as sorted lists of parts are.

    Choices are the bit masks with half of the bits, the first part's on top, which tasks enumerate and number by
    counting the choices before each.
    """
    if parts % 2:
        raise ValueError("the number of partitions is even")
    half = parts // 2
    number = F.lit(1)
    for p in range(1, parts + 1):
        # where p is passed over, all choices that take it there come before
        left = half - F.bit_count(F.shiftright("id", parts - p + 1))
        before = F.array(*[F.lit(math.comb(parts - p, r - 1) if r else 0).cast("long") for r in range(half + 1)])
        number = number + F.when(F.col("id").bitwiseAND(F.lit(1 << (parts - p))) == 0, F.get(before, left)).otherwise(F.lit(0))
    masks = spark.range(1 << parts).filter(F.bit_count("id") == half).select("id", number.cast("int").alias("split_id"))
    return masks.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts)))).select("split_id", "part", F.expr(f"(shiftright(id, {parts} - part) & 1) = 1").alias("is_train"))


#: Rows up to which the table of splits is broadcast.
BROADCAST_SPLITS = 1 << 20


def _splits(spark: SparkSession, parts: int) -> DataFrame:
    s = half_splits(spark, parts)
    return F.broadcast(s) if math.comb(parts, parts // 2) * parts <= BROADCAST_SPLITS else s


def _centred(perf: DataFrame) -> DataFrame:
    """perf with each strategy's mean c and the difference d from it."""
    return perf.join(perf.groupBy("strategy").agg(F.avg("x").alias("c")), "strategy").withColumn("d", F.col("x") - F.col("c"))


def _ratios(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, split_id, is_train, strategy, m: Sharpe ratios from centred sums per part that have met the splits."""
    g = sums.groupBy(*keys, "split_id", "is_train", "strategy").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.first("c").alias("c"))
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return g.select(*keys, "split_id", "is_train", "strategy", F.when(sd < 1e-14, F.lit(0.0)).otherwise(F.try_divide(mean + F.col("c"), sd)).alias("m"))


def split_metrics(perf: DataFrame, parts: int, metric=None) -> DataFrame:
    """split_id, is_train, strategy, m for t, strategy, x.

    The Sharpe ratio comes from centred sums per part and strategy, so the splits touch parts x
    strategies rows and not all observations; another metric (Column factory) reads the rows.
    """
    # parts are cut over distinct times, which are few against the observations
    times = folds(perf.select("t").distinct(), parts, "t").withColumnRenamed("fold", "part")
    s = _splits(perf.sparkSession, parts)
    if metric is not None:
        return perf.join(times, "t").join(s, "part").groupBy("split_id", "is_train", "strategy").agg(metric("x").alias("m"))
    sums = _centred(perf.join(times, "t")).groupBy("part", "strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.first("c").alias("c"))
    return _ratios(sums.join(s, "part"))


def _logits(m: DataFrame, *keys: str) -> DataFrame:
    best = m.filter("is_train").groupBy(*keys, "split_id").agg(F.max_by("strategy", F.struct("m", -F.col("strategy"))).alias("best"))
    w = Window.partitionBy(*keys, "split_id")
    ranked = m.filter("NOT is_train").withColumn("rank", F.row_number().over(w.orderBy("m", "strategy"))).withColumn("n", F.count(F.lit(1)).over(w))
    share = F.col("rank") / (F.col("n") + 1.0)
    j = ranked.join(best, [*keys, "split_id"]).filter(F.col("strategy") == F.col("best"))
    return j.select(*keys, "split_id", F.ln(share / (1 - share)).alias("logit")).withColumn("overfit", F.col("logit") <= 0)


def pbo_logits(perf: DataFrame, parts: int = 16, metric=None) -> DataFrame:
    """split_id, logit, overfit: where the strategy that was best in training ranks in testing."""
    return _logits(split_metrics(perf, parts, metric))


def probability_of_overfitting(perf: DataFrame, parts: int = 16, metric=None) -> DataFrame:
    return pbo_logits(perf, parts, metric).agg(F.avg(F.col("overfit").cast("double")).alias("pbo"))


def volatility_regimes(perf: DataFrame, regimes: int = 2, window: int | None = None) -> DataFrame:
    """t, smooth, regime: trailing mean of the spread across strategies, cut at its median or quantiles."""
    d = perf.groupBy("t").agg(F.stddev_pop("x").alias("d"))
    if window is None:
        window = max(perf.select("t").distinct().count() // 20, 3)
    w = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(-(window - 1), 0)
    s = d.withColumn("smooth", F.avg("d").over(w))
    levels = [0.5] if regimes <= 2 else [k / regimes for k in range(1, regimes)]
    cuts = s.agg(F.percentile("smooth", F.array(*map(F.lit, levels))).alias("cuts"))
    over = (lambda c: F.col("smooth") > c) if regimes <= 2 else (lambda c: F.col("smooth") >= c)
    return s.join(F.broadcast(cuts)).select("t", "smooth", F.size(F.filter("cuts", over)).alias("regime"))


def adaptive_overfitting(perf: DataFrame, parts: int = 16, target: float = 0.25, regimes: int = 2, metric=None) -> tuple[DataFrame, DataFrame]:
    """(pbo, ranking): splits weigh by how much of their test time is in the regime of the last `target` share."""
    if parts % 2 or not 0 < target <= 1:
        raise ValueError("an even number of partitions and a target share in (0, 1] are needed")
    n = perf.select("t").distinct().count()
    if n < parts:
        raise ValueError("there are fewer observations than partitions")
    spark = perf.sparkSession
    r = folds(volatility_regimes(perf, regimes), parts, "t").withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")))
    forward = r.filter(F.col("_k") > math.floor((1 - target) * n)).groupBy("regime").agg(F.count(F.lit(1)).alias("c"))
    label = forward.agg(F.max_by("regime", F.struct("c", -F.col("regime"))).alias("label"))
    share = r.join(F.broadcast(label)).groupBy(F.col("fold").alias("part")).agg(F.sum((F.col("regime") == F.col("label")).cast("int")).alias("same"), F.count(F.lit(1)).alias("rows"))
    tests = half_splits(spark, parts).filter("NOT is_train")
    weight = tests.join(share, "part").groupBy("split_id").agg((F.sum("same") / F.sum("rows") + 1e-3).alias("w"))
    over = pbo_logits(perf, parts, metric).join(weight, "split_id")
    pbo = over.agg((F.sum(F.col("w") * F.col("overfit").cast("double")) / F.sum("w")).alias("pbo"))
    ranking = split_metrics(perf, parts, metric).filter("NOT is_train").join(weight, "split_id").groupBy("strategy").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("score"))
    return pbo, ranking


def block_bootstrap(spark: SparkSession, n: int, block: int, draws: int, seed: int = 0) -> DataFrame:
    """draw, pos, row (from 0): each draw fills n positions with wrapped blocks of consecutive rows of n.

    A block's start is a hash of seed, draw and block, so a task that runs again draws the same rows.
    """
    block = max(block, 1)
    count = -(-n // block)
    b = spark.range(draws * count).select(F.floor(F.col("id") / count).alias("draw"), (F.col("id") % count).alias("b"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("b").cast("string"))), 1, 15), 16, 10).cast("long") % n
    k = b.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return k.select("draw", (F.col("b") * block + F.col("k")).alias("pos"), ((F.col("start") + F.col("k")) % n).alias("row")).filter(F.col("pos") < n)


def bagged_overfitting(perf: DataFrame, parts: int = 16, bags: int = 30, block: int | None = None, seed: int = 0) -> DataFrame:
    """bag, pbo of block-bootstrap resamples of t, strategy, x: the drawn times meet the observations in a join, whose
    sums per bag, part and strategy are all that the splits touch.

    Blocks are a twentieth of the times long, at least 5.  A time without a row of a strategy is left out for it.
    """
    spark = perf.sparkSession
    # distinct times are few against the observations
    times = perf.select("t").distinct().withColumn("row", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")) - 1).cast("long"))
    n = times.count()
    if n < parts:
        raise ValueError("there are fewer observations than partitions")
    base, extra = divmod(n, parts)
    cut, pos = extra * (base + 1), F.col("pos")
    part = F.when(pos < cut, F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - cut) / base)) + 1
    drawn = block_bootstrap(spark, n, block or max(n // 20, 5), bags, seed).groupBy(F.col("draw").alias("bag"), part.cast("int").alias("part"), "row").agg(F.count(F.lit(1)).alias("w"))
    rows = _centred(perf).join(times, "t").join(drawn, "row")
    sums = rows.groupBy("bag", "part", "strategy").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("d")).alias("s1"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"), F.first("c").alias("c"))
    over = _logits(_ratios(sums.join(_splits(spark, parts), "part"), "bag"), "bag")
    return over.groupBy("bag").agg(F.avg(F.col("overfit").cast("double")).alias("pbo"))


def deflated_sharpe_gate(r: np.ndarray, trials: int, spread: float, threshold: float = 0.5) -> dict:
    """Whether a Sharpe ratio passes the expected best of so many trials."""
    n, m = len(r), r.mean()
    d = r - m
    m2 = (d * d).mean()
    observed = m / math.sqrt(m2) if m2 > 0 else 0.0
    bar = expected_max(trials, 0.0, spread)
    skew = (d**3).mean() / m2**1.5 if n > 2 and m2 > 0 else 0.0
    kurt = (d**4).mean() / m2**2 if n > 3 and m2 > 0 else 3.0
    p = probabilistic_sharpe_ratio(observed, bar, n, skew, kurt)
    return {"observed_sharpe": observed, "benchmark_sharpe": bar, "n_trials": trials, "deflated_sharpe": p, "passes": p > threshold}


def deflated_sharpe_gates(returns: DataFrame, trials: int, spread: float, threshold: float = 0.5, value: str = "x", key: str = "symbol") -> DataFrame:
    """key, observed_sharpe, benchmark_sharpe, n_trials, deflated_sharpe and passes of each series, by aggregations of
    central moments; a series without deviation has ratio 0."""
    known = returns.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).alias("_x"))
    centred = known.join(known.groupBy(key).agg(F.avg("_x").alias("_m")), key).withColumn("_d", F.col("_x") - F.col("_m"))
    power = lambda k: F.avg(F.pow("_d", F.lit(k)))
    m = centred.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("_m").alias("_m"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"))
    moving = F.col("m2") > 0
    m = m.withColumns({
        "observed_sharpe": F.when(moving, F.col("_m") / F.sqrt("m2")).otherwise(0.0),
        "skew": F.when(moving & (F.col("n") > 2), F.col("m3") / F.pow("m2", F.lit(1.5))).otherwise(0.0),
        "kurt": F.when(moving & (F.col("n") > 3), F.col("m4") / (F.col("m2") * F.col("m2"))).otherwise(3.0),
        "benchmark_sharpe": F.lit(float(expected_max(trials, 0.0, spread))), "n_trials": F.lit(trials).cast("long"),
    })
    m = m.withColumn("deflated_sharpe", F.expr(psr_sql("observed_sharpe", "benchmark_sharpe", "n", "skew", "kurt")))
    return m.select(key, "observed_sharpe", "benchmark_sharpe", "n_trials", "deflated_sharpe", (F.col("deflated_sharpe") > threshold).alias("passes"))


default_metric = sharpe
