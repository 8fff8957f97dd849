"""Host-level quality rules, with DataFrame operations only.

Each document is measured once.  Rule failures are summed by host (a partial sum per task before the
shuffle, so a host with a third of all rows costs no more than another), each host's failure rate is
shrunk towards the corpus rate by an empirical beta prior, and the verdicts of hosts go back to their
documents.  Measures go through a table in the shared folder, so texts are read and scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .common import BLANKS, OWN, let, words

SYMBOLS = "#*$%&|<>"


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first find included.

    Windows are compared as 64-bit hashes of their words' hashes.  Only a text with a repeated window
    is sorted; the covered words are then counted from the gaps between such windows' places.
    """

    def covered(windows: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            m = F.size(s)
            at = lambda k: F.get(s, k)
            twice = lambda k: (F.coalesce(at(k - 1)["h"] == at(k)["h"], F.lit(False))) | F.coalesce(at(k + 1)["h"] == at(k)["h"], F.lit(False))
            places = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), m - 1), twice), lambda k: at(k)["i"]))
            return let(places, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3))).cast("long")))

        keyed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.sort_array(keyed), from_sorted))

    def windows_of(hs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hs) - 3), lambda i: F.xxhash64(F.get(hs, i), F.get(hs, i + 1), F.get(hs, i + 2)))

    return F.when(F.size(tokens) < 3, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda hs: let(windows_of(hs), covered)))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""

    def lines(t: Column) -> Column:
        return let(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    return let(
        F.coalesce(text.cast("string"), F.lit("")),
        lambda t: let(
            words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                lines(t).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    )


def host_verdicts(measured: DataFrame, host_col: str, fails: str, threshold: float) -> DataFrame:
    """host, n, failures, shrunk rate and whether the host passes.

    The prior's mean is the corpus rate; its strength comes from the variance of host rates, weighted
    by documents, by the method of moments (at least 1, at most 10000, which is also taken when the
    hosts don't differ).
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(fails).cast("long")).alias("failures"))
    stats = hosts.agg(F.sum("n").cast("double").alias("n_all"), F.sum("failures").cast("double").alias("f_all"), F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("ff"))
    mean = F.col("f_all") / F.col("n_all")
    variance = F.greatest(F.col("ff") / F.col("n_all") - mean * mean, F.lit(0.0))
    strength = F.when(variance < 1e-12, F.lit(1e4)).otherwise(F.least(F.greatest(mean * (1 - mean) / variance - 1, F.lit(1.0)), F.lit(1e4)))
    prior = stats.filter(F.col("n_all") > 0).select(mean.alias("prior_mean"), strength.alias("prior_strength"))
    # one row by construction: an aggregate without keys
    return hosts.join(F.broadcast(prior)).withColumn("host_rate", (F.col("failures") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("n") + F.col("prior_strength"))).withColumn("host_passes", F.col("host_rate") <= threshold).select("host", "n", "failures", "host_rate", "host_passes")


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_share: int = 50, max_symbol_share: int = 30, max_dup_line_share: int = 50, threshold: float = 0.5) -> DataFrame:
    """One row per document: id, host, its measures, base_failed, any_failed, host_rate and kept.

    base_failed: fewer words than min_words, or over max_repeat_share per cent of them in repeated
    3-word windows.  any_failed adds: symbols over max_symbol_share per cent of word characters, or
    repeated lines over max_dup_line_share per hundred words.  A host fails whose shrunk rate of
    any_failed is over threshold; all its documents go.

    A null text counts as empty and fails; null hosts form one host; repeated rows are judged each;
    an empty table gives an empty result.  Other columns of docs play no part.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias(OWN + "m")).select("doc_id", "host", OWN + "m.*")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    other = (100 * F.col("n_symbols") > max_symbol_share * F.col("word_chars")) | (100 * F.col("n_dup_lines") > max_dup_line_share * F.col("n_words"))
    measured = materialise(measured.withColumn("base_failed", base).withColumn("any_failed", base | other), "host-quality")
    verdicts = host_verdicts(measured, "host", "any_failed", threshold).select(F.col("host").alias(OWN + "host"), "host_rate", "host_passes")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col(OWN + "host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_passes")).drop(OWN + "host")
