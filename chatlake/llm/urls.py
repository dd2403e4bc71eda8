"""URL rules by a blocked Bloom filter and an exact hash join, in DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains. Every address gives the keys
that any rule could have: host suffixes and path prefixes of the (number of labels, length) pairs that
occur among the rules. Keys that the Bloom filter passes are joined with the rules themselves, which
removes its false positives.

Null and empty addresses and those without `://` have an empty host and path; no rule fits them. Of several rules
that fit, the longest (host and path) wins; of two of one length, that with the longer host; of an allow and a block
rule for the same key, block wins. Repeated rows are judged alike, very long addresses like others; an empty table
gives an empty table. Columns with other names are carried along unless they are named like an output column, which then
replaces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ready, table

#: The filter has one word of 64 bits per this many rules. Up to MOST_WORDS words (16 MB) it is broadcast, beyond that
#: it is joined like any table.
RULES_PER_WORD = 4
MOST_WORDS = 1 << 21
BITS_PER_RULE = 5
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
QUERY_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of an address."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _SMALL)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule string")


def _mask(key: Column) -> Column:
    """The bits of a key inside its word."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(BITS_PER_RULE)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with `host`, `path`, `rule` (null where none fits) and `verdict` (then `default`).

    rules: `verdict`, and `rule` as host and path in one string. Rules that are null, or have no `/`, are ignored."""
    ready(pages.sparkSession)
    rules = rules.select("verdict", "rule").where(F.locate("/", "rule") > 0)
    slash = F.locate("/", F.col("rule"))
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _SMALL)
    path = F.col("rule").substr(slash, F.length("rule"))
    rules = rules.select("verdict", "rule", F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("length"))
    rules = rules.groupBy("key").agg(F.max_by(F.struct("rule", "verdict"), F.struct("verdict", "rule")).alias("hit"), F.max("labels").alias("labels"), F.max("length").alias("length"))
    n = rules.count()
    words = 1 << max(6, math.ceil(math.log2(max(1, n / RULES_PER_WORD))))
    bloom = rules.groupBy(_word(F.col("key"), words).alias("word")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
    shapes = rules.groupBy("labels", "length").agg(F.lit(0).alias("one")).groupBy("one").agg(F.collect_list(F.struct("labels", "length")).alias("shapes"))

    h, p = url_parts(F.col(url_col))
    pages = pages.select("*", h.alias("__host"), p.alias("__path"))
    parts = pages.where("__host <> ''").select(F.col("__host").alias("h"), F.col("__path").alias("p")).distinct()
    labels = F.split("h", r"\.")
    key = F.transform(
        "shapes",
        lambda s: F.when(
            (F.size("labels") >= s["labels"]) & (F.length("p") >= s["length"]),
            F.concat(F.array_join(F.slice("labels", F.size("labels") - s["labels"] + 1, s["labels"]), "."), F.col("p").substr(F.lit(1), s["length"])),
        ),
    )
    keys = parts.withColumn("one", F.lit(0)).join(F.broadcast(shapes), "one").withColumn("labels", labels).select("h", "p", F.explode(F.array_compact(key)).alias("key"))
    bloom = F.broadcast(bloom) if words <= MOST_WORDS else bloom
    possible = keys.withColumn("word", _word(F.col("key"), words)).join(bloom, "word").where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    # no hint: the rules are broadcast only below the session's size limit, else AQE splits hot keys
    hits = possible.select("h", "p", "key").join(rules.select("key", "hit"), "key")
    best = hits.groupBy("h", "p").agg(F.max_by("hit", F.struct(F.length("key"), F.locate("/", "key"))).alias("__hit"))
    joined = pages.join(best, (pages["__host"] == best["h"]) & (pages["__path"] == best["p"]), "left")
    keep = [c for c in pages.columns if c not in ("__host", "__path", "host", "path", "rule", "verdict")]
    return joined.select(*(pages[c] for c in keep), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__hit.rule").alias("rule"), F.coalesce(F.col("__hit.verdict"), F.lit(default)).alias("verdict"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, QUERY_RULES)).drop("url")


OP5_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT u.*, (SELECT arg_max(struct_pack(rule := rhost || rpath, verdict := v), length(rhost || rpath)) FROM r
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit FROM u
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM f
"""
