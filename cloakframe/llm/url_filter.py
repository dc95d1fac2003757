"""URL filter [native]: a blocked Bloom filter of listed keys passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The most 64-bit blocks the filter may have: 8 MB, however long the list is. A longer list only lets more false positives
#: through to the exact join, so the broadcast below has a fixed bound and the result never depends on it.
MAX_BLOCKS = 1 << 20
#: The production rules of the query: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Four bits of one 64-bit block."""
    h = F.xxhash64(F.lit(7), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def bloom(rules: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """(block, bits) of the non-empty blocks, and the number of blocks: two keys a block on average, up to MAX_BLOCKS."""
    n = max(1, rules.count())
    blocks = min(MAX_BLOCKS, max(16, n // 2))
    return rules.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits")), blocks


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    rules: (verdict, host, path) rows, host in lower case. A rule fits its host and every subdomain of it if the url's
    path starts with the rule's path; the longest host + path wins (ties: the smaller rule, then the smaller verdict).
    Null urls and urls without "://" have empty host and path, no rule and the default verdict. Repeated rows give
    repeated results; null ids and other columns (whatever their names) do no harm. Empty tables give empty results.

    Each url yields its (host suffix, path prefix) keys, prefixes only at lengths that occur in the rules; those that the
    filter lets through meet the exact table. All of it is expressions and hash joins: no Python on the executors.
    """
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("plen")).filter("key is not null")
    lengths = sorted(r[0] for r in listed.select("plen").distinct().collect())  # as many as there are path lengths
    exact = listed.groupBy("key").agg(F.min("verdict").alias("r_verdict")).withColumnRenamed("key", "r_key")
    filt, blocks = bloom(exact, "r_key")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(cuts, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    probes = rows.filter("host <> ''").select("id", "url", F.explode(F.array_distinct(keys)).alias("key"))
    probes = probes.select("id", "url", "key", _block(F.col("key"), blocks).alias("at"), _mask(F.col("key")).alias("mask"))
    maybe = probes.join(F.broadcast(filt), (F.col("at") == F.col("block")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")))
    hits = maybe.join(exact, F.col("key") == F.col("r_key"))  # exact; broadcast only under Spark's own size threshold
    best = hits.groupBy("id", "url").agg(F.min(F.struct((-F.length("r_key")).alias("l"), "r_key", "r_verdict")).alias("best"))
    best = best.select(F.col("id").alias("b_id"), F.col("url").alias("b_url"), "best")
    got = rows.join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("url") == F.col("b_url")), "left")
    return got.select(F.col("id").alias(id_col), "host", "path", F.col("best.r_key").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(verdict, host, path) rows of a short list, as VALUES: a local relation of the plan, no Python."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({', '.join(map(quote, r))})" for r in rules) + " as t(verdict, host, path)")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the production rules on every url of pages; see judge_urls()."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


OP10_SQL = r"""
with rules(verdict, host, path) as (values ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
p as (select page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path from pages),
m as (select page_id, url, max_by(r.host || r.path, length(r.host || r.path)) rule_, max_by(r.verdict, length(r.host || r.path)) v
  from (select distinct * from p) p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by 1, 2)
select p.page_id, p.host, p.path, m.rule_ as rule, coalesce(m.v, 'allow') as verdict from p left join m on p.page_id = m.page_id and p.url = m.url
"""
