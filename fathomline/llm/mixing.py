"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  The cells' weights are raked in turn to the target
shares of sources, languages and topics until all three margins fit.  A document's rate is its cell's
fitted weight over its cell's tokens, scaled so that the expected tokens are the budget.  Below 1 it is
the probability to be taken; a cell that needs more than its documents repeats them, since clipping its
rate would move the sample's margins off their targets.

Up to MOST_CELLS cells are raked on the driver, beyond that by DataFrame aggregations: the same steps in
the same order with the same stopping rule, so only rounding differs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_path, materialise, scratch_path
from .common import OWN, let, words

MOST_CELLS = 100_000
#: Raking ends when no margin is further from its target, or after so many rounds.
TOLERANCE, ROUNDS = 1e-9, 500
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse kind of text: table, loud, note, long or prose."""
    return let(
        F.coalesce(text.cast("string"), F.lit("")),
        lambda t: F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("!!")), "loud").when(F.length(t) < 600, "note").when(F.length(t) > 8000, "long").otherwise("prose"),
    )


def tempered(shares: dict, exponent: float) -> dict:
    """Shares to a power below 1, which lifts small groups; they sum to 1 again."""
    total = sum(s**exponent for s in shares.values())
    return {k: s**exponent / total for k, s in shares.items()}


def rake(codes: list[np.ndarray], targets: list[np.ndarray], start: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Cell weights whose margins are the targets, none over `most`; codes: each cell's place per dimension.

    Where empty cells or bounds rule the targets out, the weights of the last round are returned.
    """
    w = start
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets):
            margin = np.bincount(code, w, len(target))
            worst = max(worst, np.abs(margin - target).max())
            w = w * np.divide(target, margin, out=np.zeros_like(margin), where=margin > 0)[code]
            if most is not None:
                w = np.minimum(w, most)
        if worst < TOLERANCE:
            break
    return w


def _budget(share: float, have: np.ndarray, goal: np.ndarray) -> float:
    """The part of all tokens up to `share` at which no group needs more tokens than it has."""
    return min(share, (have[goal > 0] / goal[goal > 0]).min(initial=share))


def cell_rates(cells: DataFrame, exponent: float, targets: dict, share: float, repeat: bool) -> DataFrame:
    """cells (source, lang, topic, tokens), MOST_CELLS of them at most, with weight and probability."""
    spark = cells.sparkSession
    rows = sorted(cells.collect(), key=lambda r: [str(r[d]) for d in DIMENSIONS])
    tokens = np.array([float(r["tokens"]) for r in rows])
    total = tokens.sum()
    weight, rate = np.zeros(len(rows)), np.ones(len(rows))
    if total:
        codes, goals, budget = [], [], share
        for d in DIMENSIONS:
            place = {n: k for k, n in enumerate(dict.fromkeys(r[d] for r in rows))}
            code = np.array([place[r[d]] for r in rows])
            have = np.bincount(code, tokens, len(place)) / total
            goal = np.array([float(targets[d].get(n, 0.0)) for n in place]) if d in targets else have**exponent
            goal = np.where(have > 0, goal, 0.0)
            goal = goal / goal.sum() if goal.sum() else goal
            codes.append(code)
            goals.append(goal)
            budget = budget if repeat else _budget(budget, have, goal)
        weight = rake(codes, goals, tokens / total, None if repeat or not budget else tokens / total / budget)
        rate = np.divide(budget * total * weight, tokens, out=rate, where=tokens > 0)
    return spark.createDataFrame([(*(r[d] for d in DIMENSIONS), float(w), float(q)) for r, w, q in zip(rows, weight, rate)], "source string, lang string, topic string, weight double, probability double")


def cell_rates_by_tables(cells: DataFrame, exponent: float, targets: dict, share: float, repeat: bool) -> DataFrame:
    """The same with the cells in a table: each step is an aggregation and a join on one dimension, and a
    round's weights are written before the next one reads them."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    total, paths, goals, budget = float(total), [], {}, share

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "mixing-weights"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    for d in DIMENSIONS:
        have = cells.groupBy(F.col(d).alias(OWN + d)).agg((F.sum("tokens") / total).alias("have"))
        if d in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], "name string, goal double")
            have = have.join(given, F.col(OWN + d).eqNullSafe(F.col("name")), "left").drop("name")
        else:
            have = have.withColumn("goal", F.pow("have", F.lit(exponent)))
        have = have.withColumn("goal", F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(F.lit(0.0)))
        whole = have.agg(F.sum("goal")).first()[0] or 1.0
        goals[d] = written(have.withColumn("goal", F.col("goal") / whole))
        if not repeat:
            least = goals[d].filter("goal > 0").agg(F.min(F.col("have") / F.col("goal"))).first()[0]
            budget = budget if least is None else min(budget, least)
    w = written(cells.withColumn("weight", F.col("tokens") / total))
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            margins = w.groupBy(F.col(d).alias(OWN + "name")).agg(F.sum("weight").alias("margin"))
            margins = written(goals[d].join(margins, F.col(OWN + d).eqNullSafe(F.col(OWN + "name"))).select(OWN + d, "goal", "margin"))
            worst = max(worst, margins.agg(F.max(F.abs(F.col("margin") - F.col("goal")))).first()[0])
            weight = F.col("weight") * F.when(F.col("margin") > 0, F.try_divide("goal", "margin")).otherwise(F.lit(0.0))
            if not repeat and budget:
                weight = F.least(weight, F.col("tokens") / (total * budget))
            w = w.join(margins, F.col(d).eqNullSafe(F.col(OWN + d))).withColumn("weight", weight).drop(OWN + d, "goal", "margin")
        w = written(w)
        if worst < TOLERANCE:
            break
    for path in paths[:-1]:
        drop_path(spark, path)
    rate = F.when(F.col("tokens") > 0, F.col("weight") * (budget * total) / F.col("tokens")).otherwise(F.lit(1.0))
    return w.select(*DIMENSIONS, "weight", rate.alias("probability"))


def uniform(identifier: Column) -> Column:
    """A number in [0, 1) from md5 of the identifier as text; null counts as empty."""
    text = F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, exponent: float = 0.7, targets: dict | None = None, share: float = 0.8, repeat: bool = True) -> DataFrame:
    """docs with topic, n_tokens, weight (of its cell), probability, selected and copies.

    targets: {"source" | "lang" | "topic": {name: share}}; a dimension without targets gets its own
    shares to the power `exponent`.  share: expected tokens of the sample, as a part of all tokens.
    probability is the expected number of copies: above 1 the document is in the sample as often as its
    whole part says, and once more if a number in [0, 1) hashed from its identifier is below the rest.
    selected says that there is a copy.  Equal identifiers fare alike and a second run gives the same sample.
    Without repeat no document comes twice: the share is lowered to the greatest at which no source,
    language or topic needs more tokens than it has, and cells are raked with their own tokens as bounds,
    so the expected margins are the targets again, unless bounds and empty cells together rule them out.

    Nulls of source, language or topic form groups of their own (name None in targets).  Documents without a word have no
    tokens; a cell of only such documents is kept whole.  An empty table gives an empty result.
    Columns of docs with a result's name are replaced.
    """
    added = ("topic", "n_tokens", "weight", "probability", "selected", "copies")
    topic = topic if topic is not None else topic_of(F.col(text_col))
    keys = {OWN + "source": F.col(source_col).cast("string"), OWN + "lang": F.col(lang_col).cast("string"), OWN + "topic": topic}
    keyed = docs.withColumns(keys)
    counted = keyed.select(*keys, F.size(words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("long").alias("n"))
    cells = materialise(counted.groupBy(*keys).agg(F.sum("n").alias("tokens")).toDF(*DIMENSIONS, "tokens"), "mixing-cells")
    few = cells.count() <= MOST_CELLS
    rates = (cell_rates if few else cell_rates_by_tables)(cells, exponent, targets or {}, share, repeat)
    rates = rates.toDF(*(OWN + "r_" + d for d in DIMENSIONS), OWN + "weight", OWN + "probability")
    rates = F.broadcast(rates) if few else rates
    same = [F.col(OWN + d).eqNullSafe(F.col(OWN + "r_" + d)) for d in DIMENSIONS]
    joined = keyed.join(rates, same[0] & same[1] & same[2], "left")
    kept = [c for c in docs.columns if c not in added or c in (id_col, text_col, source_col, lang_col)]
    drawn, rate = uniform(F.col(id_col)), F.col(OWN + "probability")
    n_tokens = F.size(words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("long")
    return joined.select(*kept, F.col(OWN + "topic").alias("topic"), n_tokens.alias("n_tokens"), F.col(OWN + "weight").alias("weight"), F.col(OWN + "probability").alias("probability"), (drawn < rate).alias("selected"), (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).alias("copies"))
