"""Entropy of messages: n-gram counts as aggregations, parse-based estimators as vectorised UDFs."""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma
from ..runtime import ship, shuffle_partitions

LN2 = math.log(2)


def ngrams(messages: DataFrame, width: int, key: str = "id", text: str = "message", outer: bool = False) -> DataFrame:
    """key, word, n: overlapping runs of `width` code points and their counts; words have no nulls, but with outer a
    message without runs has one, and the count 0.

    A message is cut into its characters once and runs are joined slices of that array, so the work is
    linear in its length.  Messages are dealt out by key first, and counts need no further shuffle.
    """
    split = dealt(messages, key, text).select(key, F.split(F.col(text), "").alias("_c"))
    words = split.select(key, (F.explode_outer if outer else F.explode)(_runs(F.col("_c"), width)).alias("word"))
    return words.groupBy(key, "word").agg(F.count("word").alias("n"))


def dealt(messages: DataFrame, key: str, text: str) -> DataFrame:
    """Messages spread over tasks, as a few files may hold many long ones."""
    return messages.select(key, text).repartition(shuffle_partitions(messages.sparkSession), key)


def _runs(characters: Column, width: int) -> Column:
    """All runs of an array of characters; splitting empty text gives one empty character, which is left out."""
    whole = F.filter(characters, lambda c: c != "")
    if width == 1:
        return whole
    starts = F.when(F.size(characters) >= width, F.sequence(F.lit(0), F.size(characters) - width))
    return F.transform(starts, lambda i: F.concat(*[F.get(characters, i + k) for k in range(width)]))


def mass_function(messages: DataFrame, width: int, key: str = "id", text: str = "message") -> DataFrame:
    counts = ngrams(messages, width, key, text)
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return counts.join(totals, key).select(key, "word", (F.col("n") / F.col("total")).alias("p"))


def plug_in_entropy(messages: DataFrame, width: int = 1, key: str = "id", text: str = "message", corrected: bool = False) -> DataFrame:
    """key, entropy in bits per symbol, from counts alone: log2 N - (sum n log2 n) / N, over the width.

    corrected adds the Miller-Madow term.  With width 1 this is Shannon's entropy.  Empty messages and
    those shorter than the width have no row.
    """
    sums = ngrams(messages, width, key, text).groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.count(F.lit(1)).alias("kinds"))
    bits = F.log2("total") - F.col("nlogn") / F.col("total")
    if corrected:
        bits = bits + (F.col("kinds") - 1.0) / (2.0 * F.col("total") * LN2)
    return sums.select(key, (bits / width).alias("entropy"))


def _half_digamma(n: Column) -> Column:
    """digamma of half an odd number, n // 2 + 1/2: ten steps of its recurrence, then the asymptotic series."""
    low = F.floor(n / 2) + 0.5
    y = low + 10
    f = 1 / (y * y)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))
    steps = functools.reduce(lambda a, b: a + b, [1 / (low + k) for k in range(10)])
    return F.log(y) - 0.5 / y - series - steps


def grassberger_entropy(messages: DataFrame, width: int = 1, key: str = "id", text: str = "message") -> DataFrame:
    """key, entropy in bits per symbol: ln N - (sum n G(n)) / N over the width, with G(n) = ln 2 + digamma(n // 2 + 1/2).

    That is digamma(n) + (-1)^n (digamma((n + 1) / 2) - digamma(n / 2)) / 2 in one term.  Counts are aggregated, so no
    message is in one piece in Python.  A null or empty message, and one shorter than the width, has entropy 0.
    """
    g = F.when(F.col("n") > 0, F.col("n") * (_half_digamma(F.col("n")) + LN2))
    sums = ngrams(messages, width, key, text, outer=True).groupBy(key).agg(F.sum("n").alias("total"), F.sum(g).alias("ng"))
    nats = F.log("total") - F.try_divide(F.col("ng"), F.col("total"))
    return sums.select(key, F.coalesce(nats / (LN2 * width), F.lit(0.0)).alias("entropy"))


def lempel_ziv(message: str) -> float:
    """Phrases of an incremental parse over the message's length; a repeated last phrase adds none."""
    phrases, start, n = set(), 0, len(message)
    while start < n:
        end = start + 1
        while end <= n and message[start:end] in phrases:
            end += 1
        phrases.add(message[start:end])
        start = end
    return len(phrases) / n if n else 0.0


def match_length(message: str, i: int, n: int) -> tuple[int, str]:
    """1 + length of the longest run at i that also starts within the n symbols before i, and that run."""
    best = ""
    for size in range(1, min(n, len(message) - i) + 1):
        run = message[i : i + size]
        if message.find(run, max(0, i - n), i - 1 + size) < 0:
            break
        best = run
    return len(best) + 1, best


def earlier_matches(message: str) -> list[int]:
    """For each place the length of the longest run from there that also starts further left; runs may overlap.

    One pass over a suffix automaton whose states know where their first occurrence ends: linear in the
    message's length.
    """
    follow, link, size, ends = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(message):
        state = len(size)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = state
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if size[q] == size[p] + 1:
                link[state] = q
            else:
                twin = len(size)
                follow.append(dict(follow[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                ends.append(ends[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    out, state, length, n = [], 0, 0, len(message)
    for i in range(n):
        while i + length < n and (to := follow[state].get(message[i + length])) is not None and ends[to] < i + length:
            state, length = to, length + 1
        out.append(length)
        if length:
            length -= 1
            while state and size[link[state]] >= length:
                state = link[state]
    return out


def kontoyiannis(message: str, window: int | None = None) -> float:
    """Mean of log2 of the places to look back over the length of the match there; without a window all
    places before count, and matches come from one linear pass."""
    n = len(message)
    window = min(window, n - 1) if window else None
    if window is None:
        found = earlier_matches(message)
        rates = [math.log2(i) / (min(found[i], i) + 1) for i in range(2, n)]
        return sum(rates) / len(rates) if rates else 0.0
    points = range(window if window is not None else 2, n)
    rates = [math.log2(window or i) / match_length(message, i, window or i)[0] for i in points if (window if window is not None else i)]
    return sum(rates) / len(rates) if rates else 0.0


def counts_of(message: str, width: int) -> np.ndarray:
    return np.array(list(Counter(message[i : i + width] for i in range(len(message) - width + 1)).values()), float)


@functools.lru_cache(4096)
def _concentrations(points: int, k: int) -> np.ndarray:
    """Dirichlet concentrations whose prior mean entropy is each node: bisection on all at once."""
    targets = _nodes(points, k)
    lo, hi = np.full(len(targets), 1e-8), np.full(len(targets), 1e8)
    for _ in range(200):
        mid = (lo + hi) / 2
        low = digamma(k * mid + 1) - digamma(mid + 1) < targets
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def _nodes(points: int, k: int) -> np.ndarray:
    return np.linspace(math.log(k) / (points + 1), math.log(k) * points / (points + 1), points)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def nsb(message: str, width: int = 1, alphabet: int | None = None, points: int = 80) -> float:
    """Posterior mean entropy over concentrations with an even prior on entropy."""
    c = counts_of(message, width)
    if not len(c):
        return 0.0
    k = max(max(alphabet or len(set(message)), 1) ** width, len(c))
    n = c.sum()
    if k <= 1:
        return 0.0
    nodes, beta = _nodes(points, k), _concentrations(points, k)
    b = beta[:, None]
    # equal counts have equal terms
    c, times = np.unique(c, return_counts=True)
    evidence = _lgamma(k * beta) - _lgamma(n + k * beta) + ((_lgamma(c + b) - _lgamma(b)) * times).sum(1)
    seen = ((c + b) * digamma(c + b + 1) * times).sum(1)
    mean = digamma(n + k * beta + 1) - (seen + (k - times.sum()) * beta * digamma(beta + 1)) / (n + k * beta)
    weight = np.exp(evidence - evidence.max())
    norm = np.trapezoid(weight, nodes)
    return float(np.trapezoid(weight * mean, nodes) / norm / LN2 / width) if norm > 0 else math.nan


ESTIMATORS = {"lempel_ziv": lempel_ziv, "kontoyiannis": kontoyiannis, "nsb": nsb}


def message_entropy(messages: DataFrame, estimator: str, key: str = "id", text: str = "message", **parameters) -> DataFrame:
    """key, entropy by a parse-based or Bayesian estimator; a null message is empty."""
    ship(messages.sparkSession)
    fn = ESTIMATORS[estimator]

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: fn(m or "", **parameters))

    return dealt(messages, key, text).select(key, run(F.col(text)).alias("entropy"))
