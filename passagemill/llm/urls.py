"""URL filters: host-suffix and path-prefix expressions, joined to rules by hash prefix and confirmed by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rule rows up to which the rules are sent to every task; a longer list is joined by shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the join compares first.
PREFIX = 8
#: Parts of each rule in a join by shuffle.
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """The path up to its last slash: what a rule is looked up by, whether its path ends there or not."""
    return F.regexp_extract(path, r"^([\s\S]*/)?", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The (host suffix, path folder) of a url for every shape (labels, slashes) that some rule has and the url is long enough for.

    No other can meet a rule, so a url costs its length for each shape, however
    many labels and folders it has.
    """
    every = F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(b).alias("slashes")) for a, b in shapes))
    fits = F.filter(every, lambda x: (x["labels"] <= _labels(host)) & (x["slashes"] <= _slashes(path)))
    return F.transform(
        fits,
        lambda x: F.struct(
            F.call_function("substring_index", host, F.lit("."), -x["labels"]).alias("suffix"),
            F.when(x["slashes"] == 0, "").otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), x["slashes"]), F.lit("/"))).alias("folder"),
        ),
    )


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits), verdict.

    rules has verdict, host and path.  A rule fits its host and all subdomains
    where the url's path starts with the rule's; the longest host and path
    together win, then the longer host, then block before allow.  No fit gives
    the default verdict.  A url that is null or lacks "://" has an empty host
    and path, and no rule fits it.  Null keys and repeated rows keep their own
    rows; an empty rule table gives every page the default.  Rules with a null
    part count as empty there and fit no url.  Other columns are ignored.

    Of each url's host suffixes and path folders those are made that rules have
    the like of, by number of labels and slashes, so a very long url is no more
    than its length.  Expressions are matched by the first PREFIX digits of
    their digest and then by the whole digest.  The rules are broadcast only if
    they are counted to be BROADCAST_RULES at most; a longer list is joined by
    shuffle, each rule in SALTS parts, so one that very many urls meet is spread.
    """
    urls = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    asked = urls.select("k", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    clean = rules.select(
        "verdict", F.lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")
    ).filter("rule_host <> ''")
    folder = _folder(F.col("rule_path"))
    digest = _digest(F.col("rule_host"), folder)
    clean = clean.select("*", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("short"), _labels(F.col("rule_host")).alias("labels"), _slashes(folder).alias("slashes"))
    shapes = sorted((r["labels"], r["slashes"]) for r in clean.select("labels", "slashes").distinct().collect())
    tried = asked.select("k", "u", "path", F.explode(_expressions(F.col("host"), F.col("path"), shapes)).alias("e")) if shapes else asked.select("k", "u", "path", F.struct(F.lit("").alias("suffix"), F.lit("").alias("folder")).alias("e")).limit(0)
    digest = _digest(F.col("e.suffix"), F.col("e.folder"))
    tried = tried.select("k", "u", "path", digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("short"), F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).alias("salt"))
    if clean.count() <= BROADCAST_RULES:
        joined = tried.join(F.broadcast(clean), "short")
    else:
        joined = tried.join(clean.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["short", "salt"])
    hits = joined.filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("h"), F.col("verdict").alias("v"), F.col("rule_host"), F.col("rule_path")
    )
    best = hits.groupBy("k", "u").agg(F.max(order).alias("won"))
    out = urls.join(best.select(F.col("k").alias("bk"), F.col("u").alias("bu"), "won"), F.col("k").eqNullSafe(F.col("bk")) & F.col("u").eqNullSafe(F.col("bu")), "left")
    return out.select(
        F.col("k").alias(key),
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
        F.concat("won.rule_host", "won.rule_path").alias("rule"),
        F.coalesce("won.v", F.lit(default)).alias("verdict"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(
        "SELECT * FROM VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/') AS r(verdict, host, path)"
    )
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH urls AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(v, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), judged AS (
  SELECT page_id, host, path,
         (SELECT max({'size': length(h) + length(p), 'rule': h || p, 'v': v}) FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS won
  FROM urls
)
SELECT page_id, host, path, won.rule AS rule, coalesce(won.v, 'allow') AS verdict FROM judged
"""
