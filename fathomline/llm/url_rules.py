"""URL filters by a sort-merge range join, with DataFrame operations only.

A host is written as its labels in reverse, each followed by the lowest separator, so all subdomains
of a rule's host lie in one interval of keys; a path behind its host's key puts all urls whose path
starts with a rule's into one interval too.  Intervals are nested or apart, so the boundary before a
key tells which rules are active there.  Two sorted sweeps decide a url:
  1. over hosts: the stack of nested rule hosts that are active, the url's host or hosts above it;
  2. over (host of that stack, path): the innermost active rule of that host.
The best of a url's rules is then chosen among the hosts of its stack, of which there are at most as
many as its host has labels.

A sweep deals urls and boundaries to ranges of keys by sampled splitters, urls of one key by a hash as
well, so neither a hot host nor a hot url fills a task.  What is active where a range begins is the last
boundary before it, found from one row per range.  A boundary is in one range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialise, shuffle_partitions
from .common import OWN, ascii_lower, let

SEP, AFTER = "\x01", "\x02"
RANGE, KIND, TIE = OWN + "range", OWN + "kind", OWN + "tie"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def host_labels(host: Column) -> Column:
    """Labels in reverse; the separators' characters are replaced within labels."""
    return F.reverse(F.split(F.translate(host, SEP + AFTER, "\x03\x03"), r"\."))


def key_of(labels: Column) -> Column:
    return F.concat(F.array_join(labels, SEP), F.lit(SEP))


def end_of(key: Column) -> Column:
    """Bytes after all keys that begin with key: no text has the byte 255."""
    return F.concat(key.cast("binary"), F.unhex(F.lit("FF")))


def host_boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from key on, up to the next one, the rule hosts of stack are active."""
    hosts = rules.select("host").distinct().withColumn("labels", host_labels(F.col("host"))).withColumn("key", key_of(F.col("labels")))
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: key_of(F.slice("labels", 1, n)))).alias("above"))
    active = above.join(hosts.select(F.col("key").alias("above"), "host"), "above")
    stacks = active.groupBy("key").agg(F.collect_set("host").alias("at"), F.collect_set(F.when(F.col("above") != F.col("key"), F.col("host"))).alias("beneath"))
    opened = stacks.select(F.col("key").cast("binary").alias("key"), F.col("at").alias("stack"))
    return opened.unionByName(stacks.select(end_of(F.col("key")).alias("key"), F.col("beneath").alias("stack")))


def path_boundaries(rules: DataFrame) -> DataFrame:
    """(key, rule): from key on, up to the next one, rule is the innermost of its host, or null."""
    own = rules.withColumn("key", path_key(F.col("host"), F.col("path")))
    # the longest path of the host's rules that this path begins with is active again where this one ends
    starts = own.select("host", "key", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("start"), "path").filter("start <> path")
    around = starts.join(rules.select("host", F.col("path").alias("start"), F.struct("host", "path", "verdict").alias("rule")), ["host", "start"])
    around = around.groupBy("key").agg(F.max_by("rule", F.length("start")).alias("outer"))
    opened = own.select(F.col("key").cast("binary").alias("key"), F.struct("host", "path", "verdict").alias("rule"))
    return opened.unionByName(own.join(around, "key", "left").select(end_of(F.col("key")).alias("key"), F.col("outer").alias("rule")))


def path_key(host: Column, path: Column) -> Column:
    return F.concat(key_of(host_labels(host)), F.lit(AFTER), path)


def sweep(rows: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """rows with `value` of the last of marks at or before their key; marks: (key, value), keys distinct.

    rows has key (binary) and TIE, a number by which rows of one key may be dealt to several ranges.
    The dealt rows are written down, so that all that follows sees the same ranges, as a second sampling
    would give others.
    """
    n = shuffle_partitions(rows.sparkSession)
    columns = [F.col(c) for c in rows.columns]
    marks = marks.select("key", F.struct(value).alias(OWN + "mark")).withColumn(KIND, F.lit(0)).withColumn(TIE, F.lit(0).cast("long"))
    both = rows.withColumn(KIND, F.lit(1)).unionByName(marks, allowMissingColumns=True)
    ranged = materialise(both.repartitionByRange(n, "key", KIND, TIE).withColumn(RANGE, F.spark_partition_id()), "url-ranges")
    # one row per range: its last mark, then the last one of the ranges before
    last = ranged.filter(F.col(KIND) == 0).groupBy(RANGE).agg(F.max_by(OWN + "mark", "key").alias(OWN + "last"))
    ranges = ranged.select(RANGE).distinct().join(last, RANGE, "left")
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(RANGE, F.last(OWN + "last", ignorenulls=True).over(before).alias(OWN + "carried"))
    swept = ranged.withColumn(OWN + "here", F.last(OWN + "mark", ignorenulls=True).over(Window.partitionBy(RANGE).orderBy("key", KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = swept.filter(F.col(KIND) == 1).join(F.broadcast(carried), RANGE, "left")
    return found.select(*columns, F.coalesce(OWN + "here", OWN + "carried")[value].alias(value))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule and verdict.

    rules: host, path, verdict (allow or block).  A rule fits its host and all subdomains where the
    url's path starts with the rule's.  The longest of host and path together wins, then the longer
    host, then the greater verdict (block).  Without a rule the verdict is `default`: what no rule
    names is let through.  Rules with a null host, path or verdict are left out.

    A null url, or one without ://, has an empty host and path and no rule.  Repeated rows are judged
    each; without rules, all urls get the default; an empty table gives an empty result.  Other
    columns of pages are neither read nor returned.
    """
    rules = rules.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string")).na.drop()
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = urls.withColumn("key", key_of(host_labels(F.col("host"))).cast("binary")).withColumn(TIE, F.xxhash64("page_id", "host", "path"))
    stacked = sweep(keyed, host_boundaries(rules), "stack")
    # a url goes on once for each rule host above it, or once without any
    each = stacked.select("page_id", "host", "path", F.posexplode_outer("stack").alias("nth", "above"))
    fits = F.col("above").isNotNull()
    each = each.withColumn("key", path_key(F.coalesce("above", "host"), F.col("path")).cast("binary")).withColumn(TIE, F.xxhash64("page_id", "path"))
    swept = sweep(each, path_boundaries(rules), "rule")
    size = F.struct((F.length("rule.host") + F.length("rule.path")).alias("size"), F.length("rule.host").alias("host_size"), F.col("rule.verdict").alias("verdict"), F.concat("rule.host", "rule.path").alias("rule"))
    # equal rows are equally judged, so they are counted and written out again
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0
    judged = swept.groupBy("page_id", "host", "path").agg(F.max(F.when(fits & F.col("rule").isNotNull() & inside("rule", "above", "path"), size)).alias("best"), F.sum(first.cast("long")).alias("n"))
    copies = judged.select("page_id", "host", "path", "best", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return copies.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def inside(rule: str, host: str, path: str) -> Column:
    """The exact check: hosts that differ in the separators' characters only share a key."""
    return (F.col(f"{rule}.host") == F.col(host)) & F.startswith(F.col(path), F.col(f"{rule}.path"))
