"""Periodic runs of words: stretches that repeat with a smallest period, found by a scan over all lags.

At lag p the array of a text's word numbers is compared with itself p words later.  A run of period p and
length m shows as m - p equal places in a row, and a stretch of equal places that long is a run of period p,
or of one that divides p and has the same bounds, as it is at least three times as long as p.  Lags go up
to the number of words over the least exponent.

A stretch as long as a run needs covers one of a lag's anchors, places a stretch's length apart.  So
all lags are first compared at their anchors, many lags in one numpy step; where the words at an anchor and the next
ones are equal, the whole array is compared at that lag and its stretches of equal places are run-length coded.
Anchors within a run already found whose period divides the lag show that run once more and are passed over.

Texts over LONG bytes have their lags cut into ranges of equal work, which Spark deals over tasks; the
runs of a text's ranges are then put together, of equal bounds the smallest period.  Shorter ones are one
range and are scanned where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, ship, shuffle_partitions
from .common import OWN
from .tokens import rows_of

#: Bytes over which a text's lags are dealt, and comparisons of a range of lags.
LONG, RANGE_WORK = 1 << 16, 1 << 22
#: Neighbouring places of an anchor that must be equal, and places compared in one numpy step.
WIDTH, STEP = 12, 1 << 18
#: Lags that every range of a text looks at to know the text's short periods.
SHORT_LAGS = 1024
#: Bytes of an Arrow batch.
FLUSH = 4 << 20

RUN = "struct<start:long,length:long,period:long>"
RESULT = f"doc_id long, n_words long, runs array<{RUN}>, top {RUN}, collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def _need(lag, least: int, exponent: int):
    """Equal places in a row that a run of this period has at least."""
    return np.maximum(least, exponent * lag) - lag


def lag_ranges(n: int, least: int, exponent: int, work: int | None = None) -> list[tuple[int, int]]:
    """Ranges [from, to) of a text's lags, each of about so many comparisons."""
    last = n // exponent
    if last < 1:
        return [(1, 1)]
    cost = np.cumsum(n / _need(np.arange(1, last + 1), least, exponent) + 1)
    parts = max(1, int(-(-cost[-1] // (work or RANGE_WORK))))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(cost, cost[-1] * np.arange(1, parts) / parts) + 1, [last]]))
    return [(int(a) + 1, int(b) + 1) for a, b in zip(cuts, cuts[1:])]


def scan(x: np.ndarray, low: int, high: int, least: int, exponent: int) -> dict[tuple[int, int], int]:
    """Periods of the runs at lags low to high - 1 by their bounds (first word, word after the last)."""
    n = len(x)
    high = min(high, n // exponent + 1)
    found: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int, int]] = []
    if low > SHORT_LAGS:
        found = scan(x, 1, SHORT_LAGS + 1, least, exponent)
        known = [(a, b, p) for (a, b), p in found.items()]
    width = int(min(WIDTH, _need(np.arange(1, least + 1), least, exponent).min()))
    a = low
    while a < high:
        # a block of lags whose anchors fit a step
        lags = np.arange(a, min(high, 2 * a + 8))
        stride = max(1, int(_need(lags, least, exponent).min()) - width + 1)
        most = max(1, (n - a - width) // stride + 1)
        lags = lags[: max(1, STEP // most)]
        at = np.arange(most) * np.maximum(1, _need(lags, least, exponent) - width + 1)[:, None]
        inside = at <= n - width - lags[:, None]
        at[~inside] = 0
        row, col = np.nonzero(inside & (x[at] == x[np.where(inside, at + lags[:, None], 0)]))
        lag, at = lags[row], at[row, col]
        for k in range(1, width):
            equal = x[at + k] == x[at + lag + k]
            lag, at = lag[equal], at[equal]
        for run in known:
            lag, at = _unexplained(lag, at, *run)
        while len(lag):
            p = int(lag[0])
            for start, end in _stretches(x, p, int(_need(p, least, exponent))):
                if (start, end) not in found:
                    found[start, end] = p
                    known.append((start, end, p))
                    lag, at = _unexplained(lag, at, start, end, p)
            other = lag != p
            lag, at = lag[other], at[other]
        a += len(lags)
    return found


def _unexplained(lag: np.ndarray, at: np.ndarray, start: int, end: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors without those that lie in a known run whose period divides the lag."""
    other = (lag % period != 0) | (at < start) | (at + lag >= end)
    return lag[other], at[other]


def _stretches(x: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """Bounds of the runs at a lag: the whole array against itself, run-length coded."""
    equal = np.zeros(len(x) - lag + 2, np.int8)
    equal[1:-1] = x[:-lag] == x[lag:]
    edges = np.flatnonzero(np.diff(equal))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= need
    return list(zip(begins[long].tolist(), (ends[long] + lag).tolist()))


def ordered(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period."""
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def top_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period, exactly; of equals the smallest start, then period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words).decode("utf-8")
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep)]).decode("utf-8")


def _batch(rows: list) -> pa.RecordBatch:
    as_run = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    cols = [[d for d, *_ in rows], [n for _, n, *_ in rows], [[as_run(r) for r in runs] for _, _, runs, _ in rows], [as_run(top_run(runs)) for _, _, runs, _ in rows], [t for *_, t in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(run), run, pa.string()))], ["doc_id", "n_words", "runs", "top", "collapsed"])


def _results(rows):
    """Batches of (doc, words, runs)."""
    held, size = [], 0
    for doc, words, runs in rows:
        text = collapse(words, runs)
        held.append((doc, len(words), runs, text))
        size += len(text) + 64 * len(runs)
        if size >= FLUSH:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3, long: int | None = None, work: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period), top and collapsed.

    Words are runs of other than ASCII white space, numbered from 0.  A run is a stretch whose smallest
    period is p and whose length is at least max(least, exponent * p), which no neighbouring word extends at
    that period; exponent is 2 at least.  top is the run of the greatest length over period (null without
    runs), of equals the one of smallest start, then period.  collapsed is the text without the words that a run
    holds after its first period.

    A null or empty text has no words, no runs and an empty collapsed text.  Null identifiers stay null and
    rows that repeat are results each.  An empty table gives an empty result.  Further columns are not read.
    """
    if exponent < 2 or least < exponent:
        raise ValueError("exponent must be 2 at least, and least no less than it")
    long = LONG if long is None else long
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(OWN + "text"))
    size = F.octet_length(OWN + "text")

    def here(batches):
        def rows():
            for b in batches:
                for doc, text in rows_of(b, "doc_id", OWN + "text"):
                    words = words_of(text)
                    yield doc, words, ordered(scan(numbers_of(words), 1, len(words), least, exponent)) if len(words) >= least else []

        yield from _results(rows())

    short = read.filter(size <= long).mapInArrow(here, RESULT)
    dealt = materialise(read.filter(size > long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    return short.unionByName(_dealt(dealt, least, exponent, work))


def _dealt(texts: DataFrame, least: int, exponent: int, work: int | None) -> DataFrame:
    """Results of texts (row, doc_id and text), whose ranges of lags are scanned by different tasks."""

    def cut(batches):
        for b in batches:
            for row, text in rows_of(b, "row", OWN + "text"):
                x = numbers_of(words_of(text))
                for low, high in lag_ranges(len(x), least, exponent, work):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([low]), pa.array([high]), pa.array([x.tobytes()], pa.binary())], ["row", "low", "high", "x"])

    def look(batches):
        for b in batches:
            for row, low, high, x in rows_of(b, "row", "low", "high", "x"):
                found = [(u, v, p) for (u, v), p in scan(np.frombuffer(x, np.int32), low, high, least, exponent).items()]
                cols = [[row] * len(found), [u for u, _, _ in found], [v - u for u, v, _ in found], [p for _, _, p in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "start", "length", "period"])

    ranges = texts.select("row", OWN + "text").mapInArrow(cut, "row long, low long, high long, x binary").repartition(shuffle_partitions(texts.sparkSession), "row", "low")
    runs = ranges.mapInArrow(look, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))

    def together(batches):
        def rows():
            for b in batches:
                for doc, text, runs in rows_of(b, "doc_id", OWN + "text", "runs"):
                    yield doc, words_of(text), [(r["start"], r["length"], r["period"]) for r in runs or ()]

        yield from _results(rows())

    return texts.join(runs, "row", "left").select("doc_id", OWN + "text", "runs").mapInArrow(together, RESULT)
