"""URL filters: hashed host-suffix and path-prefix expressions against a rule list.

Each URL is expanded into expressions ``host suffix + path prefix``; each is
hashed; a short prefix of the hash is joined with the rules' by equality; the
full digest then confirms, and the longest confirmed rule decides.  DataFrame
functions only.

Expansion makes only the (labels, path length) shapes that occur among the
rules, so any rule is found, no URL is cut short, and a URL of a hundred
thousand dots costs no more than the shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # hex digits of the joined hash prefix: 4 bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with key, digest and shape; of equal rules, block wins."""
    host, path = F.translate(F.trim("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    rules = rules.filter("host is not null and trim(host) != ''").select(host.alias("host"), path.alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return rules.select(
        rule.alias("rule"), "verdict", F.sha2(rule, 256).alias("rule_digest"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"), F.length("host").alias("host_length"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    ``rules``: host, path, verdict (``allow`` or ``block``).  A rule fits its
    host and all subdomains if the URL's path starts with the rule's path.  Of
    the rules that fit, the longest text wins, then the longer host.  URLs that
    no rule fits, null URLs and URLs without ``://`` get the default verdict and
    a null rule.  Null ids and repeated rows are kept; rules without a host
    never fit; an empty table gives no rows; other columns are ignored.

    The shapes collected to plan the expansion are distinct pairs of two small
    numbers, not rules.  The rule side is broadcast if Spark's own size check
    allows it, otherwise both sides are shuffled on the hash prefix.
    """
    rules = rule_table(rules)
    shapes = sorted(map(tuple, rules.select("labels", "path_length").distinct().collect()))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    n_labels = F.size(F.split("host", r"\."))
    expressions = [
        F.when(
            (F.col("host") != "") & (n_labels >= labels) & (F.length("path") >= length),
            F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)),
        )
        for labels, length in shapes
    ]
    expressions = F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")
    hashed = urls.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", F.sha2("expression", 256))
    found = hashed.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(
        rules.drop("labels", "path_length"), "prefix", "left")
    confirmed = F.when(
        F.col("rule_digest") == F.col("digest"),
        F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict"),
    )
    return (
        found.groupBy("row")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
