"""URL rules by hashed host-suffix and path-prefix expressions.

A URL is expanded into every (host suffix, path prefix) expression a rule could have. The
expressions are joined to the rules on the first bytes of their SHA-256; full digests confirm
a match, and the longest rule of a URL decides. Path prefixes are cut after each ``/``; rules
whose path ends elsewhere add their path length to the cuts, so any prefix can be a rule.

The rules are broadcast when their measured count is at most ``BROADCAST_RULES``; larger rule
tables are joined by a shuffle on the hash prefix, and adaptive execution splits hot ones.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule
fits; a rule with a null host, path or verdict is ignored; of equal rules the blocking one
wins; repeated pages are judged row by row; without rules every page gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.store import save

#: Rules (at most about 200 bytes each once hashed) that may be broadcast.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, "\\.")
    parts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def path_prefixes(path: Column, lengths: Column) -> Column:
    """Prefixes that end with ``/``, and those of the given lengths."""
    pieces = F.split(path, "/")
    at_slash = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/")))
    at_slash = F.when(F.contains(path, F.lit("/")), at_slash).otherwise(F.array().cast("array<string>"))
    odd = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.concat(at_slash, odd))


def expressions(host: Column, path: Column, lengths: Column) -> Column:
    hosts, paths = host_suffixes(host), path_prefixes(path, lengths)
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) as (prefix, digest, rule, verdict), one row per rule."""
    named = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    named = named.select(F.concat("host", "path").alias("rule"), "verdict")
    one = named.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    digest = F.sha2(F.col("rule"), 256)
    return one.select(F.substring(digest, 1, PREFIX_HEX).alias("r_prefix"), digest.alias("r_digest"), "rule", "verdict")


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: key, host, path, the deciding rule (or null) and the verdict."""
    paths = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    longest = paths.agg(F.max(F.length("path")).alias("n")).first()["n"] or 0
    odd = paths.where(~F.col("path").endswith("/")).select(F.length("path").alias("n")).distinct()
    lengths = sorted(r["n"] for r in odd.collect())  # at most as many as a rule path has characters
    held = save(hashed_rules(rules), "url_rules")
    known = F.broadcast(held.df) if held.rows <= BROADCAST_RULES else held.df
    cuts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    split = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    row = split.withColumn("row", F.monotonically_increasing_id())
    spread = row.withColumn("expression", F.explode_outer(expressions(F.col("host"), F.substring("path", 1, longest), cuts)))
    spread = spread.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    found = spread.join(known, F.col("prefix") == F.col("r_prefix"), "left")
    sure = F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    best = found.groupBy("row", "k", "host", "path").agg(F.max(sure).alias("best"))
    return best.select(
        F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
