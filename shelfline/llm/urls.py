"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join, in DataFrame operations only.

A rule is a canonical host with a path prefix. Each distinct URL stands for the canonical keys (host suffix, path
prefix) under which a rule could list it. A key's block of 64 bits must hold all of the key's bits for it to pass. The
filter has a block for every four rules, so that few other keys pass, and is broadcast up to MOST_BLOCKS; the filter of a
longer list is joined by block. Keys that pass are joined exactly with the rules, which removes false positives; the
longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: The contract's list: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEAST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 20  # of two numbers each, 16 MB
PER_BLOCK = 4
BITS = 6
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, F.lit("\0"), path), F.lit(blocks))


def _mask(host: Column, path: Column) -> Column:
    h = F.xxhash64(F.lit(1), host, F.lit("\0"), path)
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def blocks_for(rules: int) -> int:
    return max(LEAST_BLOCKS, 1 << max(0, -(-rules // PER_BLOCK) - 1).bit_length())


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """block, bits of the rules (verdict, host, path): one row for each block in use, `blocks` at most."""
    return rules.groupBy(_block(F.col("host"), F.col("path"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("host"), F.col("path"))).alias("bits"))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, blocks: int | None = None, most: int = MOST_BLOCKS) -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Longest: most characters of host and path; ties go to block, then to the smaller rule. Null urls and urls without :// have an empty host and path, which
    no rule fits. A listed rule that repeats counts once. Columns already named like the added ones are replaced.
    """
    rules = rules.select("verdict", "host", "path").dropna()
    blocks = blocks or blocks_for(rules.count())
    # Rules whose path ends within a part of a path: such prefixes are keys only at the lengths that these rules have.
    odd = [r.n for r in rules.where("path <> '' AND NOT endswith(path, '/')").select(F.length("path").alias("n")).distinct().collect()]  # as many as a path has characters
    df = df.drop("host", "path", "rule", "verdict")
    u = F.col(f"`{url}`")
    seen = df.select(u.alias("u")).where(u.isNotNull()).distinct().select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_host = seen.where("h <> ''").select("u", "p", F.explode(suffixes).alias("host"))
    prefixes = by_host.withColumn("n", F.explode(F.filter(F.sequence(F.lit(0), F.length("p")), lambda n: (n == 0) | (F.substring("p", n, F.lit(1)) == "/") | n.isin(*odd))))
    keys = prefixes.select("u", "host", F.substring(F.col("p"), F.lit(1), F.col("n")).alias("path"))
    keys = keys.withColumn("block", _block(F.col("host"), F.col("path"), blocks))
    filters = F.broadcast(bloom(rules, blocks)) if blocks <= most else bloom(rules, blocks)
    passed = keys.join(filters, "block").where(_mask(F.col("host"), F.col("path")).bitwiseAND(F.col("bits")) == _mask(F.col("host"), F.col("path")))
    exact = rules.select("host", "path", F.col("verdict").alias("v")).groupBy("host", "path").agg(F.max("v").alias("v"))
    hits = passed.join(exact, ["host", "path"])
    name = F.concat("host", "path")
    best = hits.groupBy("u").agg(F.max(F.struct(F.length(name).alias("n"), F.col("v"), name.alias("rule"))).alias("best"))
    k = fresh(df, "_u")
    found = best.select(F.col("u").alias(k), F.col("best.rule").alias("rule"), F.col("best.v").alias("verdict"))
    out = df.join(found, u == F.col(k), "left").drop(k)
    return out.withColumn("host", host_of(u)).withColumn("path", path_of(u)).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "verdict string, host string, path string")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page by the contract's rules; null urls and those without :// are allowed. Rows that repeat stay."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(v, h, p) AS (VALUES {rules}),
best AS (SELECT host, path, max({{'n': length(h || p), 'v': v, 'rule': h || p}}) AS b FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, '{DEFAULT}') AS verdict FROM parts LEFT JOIN best USING (host, path)"""
