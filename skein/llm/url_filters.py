"""URL filters by host-suffix and path-prefix expressions, in DataFrame operations only.

Each distinct (host, path) is expanded into the expressions that a rule could
have: host suffixes at label borders joined with prefixes of the path, at the
lengths that rules have, so the expansion is bounded by the rules and not by
the URL. Expressions meet rules in an equi-join on the first 32 bits of a
SHA-256 digest; the full digest and the strings confirm; the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path and verdict of the rules that the query applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"

PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract: both empty for null or without ``://``; only A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    # up to ? or # first: what follows holds neither host nor path
    body = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(body, "/", 1)
    path = F.substring(body, F.length(host) + 1, F.length(body))
    return F.translate(host, UPPER, LOWER), path


def expressions(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """Array of (host, path) that a rule of these lengths must equal to fit."""
    tails = F.transform(
        F.filter(F.array(*map(F.lit, host_lengths)), lambda n: (n == F.length(host)) | ((n < F.length(host)) & (F.substring(host, F.length(host) - n, F.lit(1)) == "."))),
        lambda n: F.substring(host, F.length(host) - n + 1, n),
    )
    heads = F.transform(F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(tails, lambda h: F.transform(heads, lambda p: F.struct(h.alias("x_host"), p.alias("x_path")))))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """``keep`` columns of every row, host, path, rule (null without one) and verdict.

    rules: columns host, path, verdict. Equal rules must agree; of two rules of
    equal length the one with the longer host wins, then ``block``. A null URL,
    or one without ``://``, has an empty host and path and gets ``default``.
    Repeated rows stay repeated, empty tables give empty results; without rules
    every verdict is ``default``. Columns not in ``keep`` play no part.

    Scale: URLs are made distinct before they are expanded (a hot URL is
    expanded once), and verdicts join back on (host, path), where adaptive
    execution splits a hot key. Rules are broadcast only if Spark's size
    threshold allows. The two collected lists of lengths are bounded by the
    longest rule.
    """
    host, path = url_parts(F.col(url))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    lengths = rules.agg(F.collect_set(F.length("host")).alias("hosts"), F.collect_set(F.length("path")).alias("paths")).first()
    none = F.lit(None).cast("string")
    if not lengths["hosts"]:
        return parsed.select(*keep, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    rule = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), digest(F.col("host"), F.col("path")).alias("r_digest"))
    rule = rule.withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    expanded = (
        parsed.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(lengths["hosts"]), sorted(lengths["paths"]))).alias("x"))
        .withColumn("x_digest", digest(F.col("x.x_host"), F.col("x.x_path")))
        .withColumn("prefix", F.substring("x_digest", 1, PREFIX_DIGITS))
    )
    fits = expanded.join(rule, "prefix").filter((F.col("x_digest") == F.col("r_digest")) & (F.col("x.x_host") == F.col("r_host")) & (F.col("x.x_path") == F.col("r_path")))
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(order.alias("order"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
