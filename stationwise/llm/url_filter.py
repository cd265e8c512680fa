"""URL rules by host suffix and path prefix, joined on short hash prefixes; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that are the join key.
SHORT = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end; path: from there up to "?", "#" or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row; columns with these names are replaced.

    `rules` has host, path and verdict ("allow" or "block"). A rule fits its host and all
    subdomains when the url's path starts with its own. The longest rule (host and path
    together) wins, then the longer host, then block. Without a rule: `rule` null and
    the default verdict. Null urls, and urls without "://", have empty host and path.
    Rules with a null part are void. Rows are never dropped or merged; an empty table
    of pages or of rules is fine.

    Each distinct (host, path) is expanded into the host suffixes and path prefixes of the
    shapes (number of labels, path length) that some rule has, so that work follows
    distinct places, not rows. A shape table has one row per shape, bounded by the
    longest rule, and is read by the driver; rules and places are joined by key.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    through = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*through, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    keyed = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of two verdicts on one place, block is the larger
        .select("*", F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"), F.size(labels).alias("n_labels"), F.length("path").alias("n_path"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    shapes = sorted((r.n_labels, r.n_path) for r in keyed.select("n_labels", "n_path").distinct().collect())
    places = parsed.filter("host != '' or path != ''").select("host", "path").distinct()
    if shapes:
        shape = F.explode(F.array(*[F.struct(F.lit(a).alias("n_labels"), F.lit(b).alias("n_path")) for a, b in shapes]))
        suffix = F.array_join(F.slice("labels", F.size("labels") - F.col("s.n_labels") + 1, F.col("s.n_labels")), ".")
        expanded = (
            places.withColumn("labels", labels)
            .withColumn("s", shape)
            .filter("s.n_labels <= size(labels) and s.n_path <= length(path)")
            .select("host", "path", F.sha2(F.concat(suffix, F.lit("\n"), F.substring("path", F.lit(1), F.col("s.n_path"))), 256).alias("digest"))
            .withColumn("short", F.substring("digest", 1, SHORT))
        )
        r = keyed.select(F.col("short"), F.col("digest").alias("rule_digest"), F.struct((F.length("host") + F.col("n_path")).alias("n"), F.length("host").alias("n_host"), "verdict", F.concat("host", "path").alias("rule")).alias("hit"))
        judged = expanded.join(r, "short").filter("digest = rule_digest").groupBy("host", "path").agg(F.max("hit").alias("hit"))
    else:
        judged = places.limit(0).withColumn("hit", F.lit(None).cast("struct<rule:string,verdict:string>"))
    return parsed.join(judged, ["host", "path"], "left").select(*through, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
