"""URL filtering by host-suffix and path-prefix expressions.

A rule is an expression ``host/path``.  Each URL is expanded into its host's suffixes and, for those
that some rule has, its path's prefixes.  Expressions meet the rules on the first four bytes of
their SHA-256; the full digests confirm, then the longest rule wins.  DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules whose expressions take up to this many bytes are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def rules_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(rule, verdict, host, path, labels, path_length) of (verdict, host, path) triples."""
    df = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return df.select(F.concat("host", "path").alias("rule"), "verdict", "host", "path")


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``pages`` with its host, path, winning rule (null: none) and verdict (``default`` without a rule).

    ``rules``: rule, verdict, host, path.  A rule fits its host and all subdomains when the path
    starts with its own; the longest rule wins, block before allow where the same expression
    stands twice.  Rules without a host, or with a null in any column, fit nothing; without rules every
    url gets the default.  A null url, or one without ``://``, has empty host and path and no rule;
    null urls take no part in any join.  Verdicts depend on the url alone, so each distinct url is
    judged once, whole however long, and any rows, repeated or not, take theirs (a hot url's rows are split by
    the adaptive join).  Result columns replace columns of ``pages`` with the same names; no pages give no rows.

    A url is first expanded into its host's suffixes, as long as some rule's host (at most one expression
    per label), which meet the rules' hosts; for each host met, into its path's prefixes as long
    as some path of that host.  So what arises grows with the rules that a url's hosts have, not
    with all shapes of all rules.
    """
    keyed = rules.where((F.length("host") > 0) & F.col("rule").isNotNull() & F.col("verdict").isNotNull() & F.col("path").isNotNull())
    keyed = keyed.select("rule", "verdict", "host", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("reach"), _digest(F.concat_ws("\n", "host", "path")).alias("full"))
    keyed = keyed.groupBy("full").agg(F.max_by(F.struct("rule", "verdict", "host", "labels", "reach"), "verdict").alias("r")).select("full", "r.*", F.substring("full", 1, 8).alias("short"))
    # a host has at most some dozens of labels
    labels = {r["labels"]: r["bytes"] for r in keyed.groupBy("labels").agg(F.sum(F.octet_length("rule") + F.octet_length("host") + F.lit(240)).alias("bytes")).collect()}
    small = sum(labels.values()) <= MOST_BROADCAST
    side = F.broadcast if small else lambda df: df.hint("merge")
    hosts = keyed.groupBy("host").agg(F.sort_array(F.collect_set("reach")).alias("reach")).select(_digest(F.col("host")).alias("host_full"), "reach").withColumn("host_short", F.substring("host_full", 1, 8))
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts, path = F.split("host", r"\."), F.col("path")
    lengths = F.array(*map(F.lit, sorted(labels))).cast("array<int>")
    suffixes = F.transform(F.filter(lengths, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    asked = urls.select("url", "path", F.explode(suffixes).alias("suffix")).withColumn("test", _digest(F.col("suffix"))).withColumn("host_short", F.substring("test", 1, 8))
    met = asked.join(side(hosts), "host_short").where(F.col("test") == F.col("host_full"))
    prefixes = F.transform(F.filter("reach", lambda n: n <= F.length(path)), lambda n: _digest(F.concat_ws("\n", F.col("suffix"), F.substring(path, F.lit(1), n))))
    expanded = met.select("url", F.explode(prefixes).alias("test")).select("url", "test", F.substring("test", 1, 8).alias("short"))
    fits = expanded.join(side(keyed.select("short", "full", "rule", "verdict")), "short").where(F.col("test") == F.col("full"))
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "verdict")).alias("best"))
    base = pages.drop(*(n for n in names if n != url_col))
    best = best.select(F.col("url").alias("_judged_url"), F.col("best").alias("_judged"))
    there = base.where(F.col(url_col).isNotNull()).join(best.hint("merge"), F.col(url_col) == F.col("_judged_url"), "left")
    none = F.lit(None)
    gone = base.where(F.col(url_col).isNull()).withColumns({"_judged_url": none.cast("string"), "_judged": none.cast(best.schema["_judged"].dataType)})
    out = there.unionByName(gone)
    return out.select(
        *base.columns,
        host_of(F.col(url_col)).alias(names[0]),
        path_of(F.col(url_col)).alias(names[1]),
        F.col("_judged.rule").alias(names[2]),
        F.coalesce(F.col("_judged.verdict"), F.lit(default)).alias(names[3]),
    )
