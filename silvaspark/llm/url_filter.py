r"""Operator 8: URL allow and block rules, with DataFrame functions only.

Each URL becomes its host-suffix and path-prefix expressions, restricted to the numbers of labels and the prefix lengths that rules have. They meet the
rules in an equi-join on the first 8 hex digits of a SHA-256; full digests confirm, and the best rule wins: the longest text, then
the longest host, then block before allow.

Defined cases: a null URL, or one without "://", has an empty host and path; an empty path starts with no rule's path but the empty one; without a fitting rule
the verdict is `default`; repeated rows are judged once and given back as often; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.common import maybe_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", digest_hex: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url); rules: verdict, host, path."""
    # the shapes of the rules: a few whole numbers, whatever the number of rules
    shapes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(shapes["labels"]) or [1], sorted(shapes["lengths"]) or [0]
    text = F.concat(F.col("host"), F.col("path"))
    r = rules.dropDuplicates().select(F.sha2(text, 256).alias("r_digest"), F.struct(F.length(text).alias("n"), F.length("host").alias("h"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("strict"), text.alias("rule"), F.col("verdict")).alias("hit"), F.col("host").alias("r_host"))
    r = r.withColumn("r_short", F.substring("r_digest", 1, digest_hex))
    host, path = url_parts(F.col("url"))
    each = pages.select(F.col(id_col).alias("page_id"), F.col("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    each = each.withColumn("host", host).withColumn("path", path)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    pairs = each.withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
    pairs = pairs.withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, digest_hex))
    met = pairs.join(maybe_broadcast(r), (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")) & (F.col("suffix") == F.col("r_host")), "left")
    best = met.groupBy("page_id", "url").agg(F.max("hit").alias("hit"), F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return best.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), u AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT p.*, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, CASE r.verdict WHEN 'block' THEN 0 ELSE 1 END) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
