"""URL rules (operator 1, DataFrame functions only).

A rule is a host with all its subdomains and a path prefix.  Each distinct
URL is expanded into host-suffix x path-prefix expressions, no deeper than
the deepest rule; the expressions meet the rules in an equi-join on short
hash prefixes; full digests, the exact path test and rule precedence decide.

Defined results: a null URL or one without ``://`` has empty host and path
and gets the default verdict.  An empty URL table or rule table works.  Ports
and user parts stay in the host.  Of several fitting rules the longest
``host + path`` wins, then the longer host, then ``block``, so repeated or
contradicting rules have one outcome.  Repeated pages keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lower_ascii

PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column, never null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expr: Column) -> Column:
    return F.sha2(expr, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row per rule with its digests.  The path
    up to its last ``/`` is what URLs are expanded to."""
    d = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
                     F.col("verdict").alias("r_verdict")).where(F.col("r_host").isNotNull() & F.col("r_verdict").isNotNull())
    folder = F.regexp_extract("r_path", "^(?:.*/)?", 0)
    d = (d.withColumn("r_digest", _digest(F.concat("r_host", folder)))
         .withColumn("r_labels", F.size(F.split("r_host", r"\.")))
         .withColumn("r_depth", F.size(F.split("r_path", "/")) - 1))
    return d.dropDuplicates().withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))


def _expressions(labels: int, depth: int) -> Column:
    names, parts = F.split("u_host", r"\."), F.split("u_path", "/")
    n = F.size(names)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n),
                        lambda i: F.array_join(F.slice(names, i, n), "."))
    steps = F.least(F.lit(depth), F.size(parts) - 1)
    folders = F.transform(F.sequence(F.lit(0), steps),
                          lambda j: F.when(j > 0, F.concat(F.array_join(F.slice(parts, 1, j), "/"), F.lit("/")))
                          .otherwise(F.lit("")))
    return F.flatten(F.transform(hosts, lambda h: F.transform(folders, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", key_cols: tuple[str, ...] = ("page_id",),
               default: str = "allow") -> DataFrame:
    """``key_cols``, host, path, rule (null if none fits), verdict."""
    table = rule_table(rules)
    # Two numbers and a count bound the expansion and the broadcast.
    labels, depth, n, chars = table.agg(F.max("r_labels"), F.max("r_depth"), F.count(F.lit(1)),
                                        F.sum(F.length("r_host") + F.length("r_path"))).first()
    if n and n <= BROADCAST_ROWS and chars <= 16 << 20:
        table = F.broadcast(table)
    host, path = url_parts(F.col("u_url"))
    urls = (pages.select(F.col(url_col).alias("u_url")).where(F.col("u_url").isNotNull()).distinct()
            .withColumn("u_host", host).withColumn("u_path", path).where(F.col("u_host") != ""))
    found = (urls.withColumn("u_digest", F.explode(_expressions(labels or 1, depth or 0)))
             .withColumn("u_digest", _digest(F.col("u_digest")))
             .withColumn("u_prefix", F.substring("u_digest", 1, PREFIX_HEX))
             .join(table, F.col("u_prefix") == F.col("r_prefix"))
             .where((F.col("u_digest") == F.col("r_digest")) & F.col("u_path").startswith(F.col("r_path"))))
    best = found.groupBy("u_url").agg(F.max(F.struct(
        F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"),
        (F.col("r_verdict") == "block").alias("blocks"), F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"))).alias("best"))
    # Null URLs join by a text without "://", which no rule can fit, spread by key.
    rows = pages.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(key_cols)], F.col(url_col).alias("p_url"))
    spread = F.concat(F.lit("null "), F.hash(*[f"k_{i}" for i in range(len(key_cols))]).cast("string"))
    rows = rows.withColumn("p_key", F.coalesce("p_url", spread))
    host, path = url_parts(F.col("p_url"))
    return (rows.join(best, F.col("p_key") == F.col("u_url"), "left")
            .select(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(key_cols)], host.alias("host"), path.alias("path"),
                    F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
