"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank is its place in its source
divided by the source's size, after a seeded part of a place that is the source's own, so that sources of a row or two do
not all lie in the middle. In the order of fractional ranks every stretch holds the sources in their proportions, so
cutting that order into runs of equal length gives shards that match the mixture. Both ranks come from tables dealt by
ranges of all that orders them, so that neither a large source nor many rows of one fraction or hash meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import prefix, ranked

SHARDS = 40
SEED = 7
PHASES = 1 << 20


def assign(df: DataFrame, order: list[str], source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds shard (0 to shards - 1), slot (from 0 within a shard), and rank (from 0 over all rows).

    Shard sizes are at most one apart, and so is each source's share of a shard up to the sources' rounding. A null
    source is a source of its own. order: columns that tell rows apart; rows equal in all of them are interchangeable.
    Columns already named shard, slot or rank are replaced. An empty table stays empty.
    """
    df = df.drop("shard", "slot", "rank")
    p = prefix(df)
    hashed = df.withColumn(f"{p}h", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order]))
    placed = ranked(hashed, [source], [f"{p}h", *order], f"{p}place", f"{p}n")
    own = placed.withColumn(f"{p}s", F.xxhash64(F.lit(seed), F.col(f"`{source}`"), F.col(f"`{source}`").isNull()))
    phase = (F.pmod(f"{p}s", F.lit(PHASES)) + 0.5) / PHASES
    spread = own.withColumn(f"{p}f", (F.col(f"{p}place") + phase) / F.col(f"{p}n"))
    mixed = ranked(spread, [], [f"{p}f", f"{p}s", source, f"{p}h", *order], "rank", f"{p}total")
    cut = mixed.withColumn("shard", F.expr(f"(rank * {shards}) div `{p}total`").cast("int"))
    cut = cut.withColumn("slot", F.col("rank") - F.expr(f"(shard * `{p}total` + {shards - 1}) div {shards}"))
    return cut.drop(*[f"{p}{x}" for x in ("h", "s", "n", "f", "place", "total")])


def write_shards(df: DataFrame, path: str) -> None:
    """Writes an assigned table, a folder for each shard, rows by slot."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under law `rows`; groups (equal texts) are not kept together. Rows that share a doc_id
    are rows of their own; null texts count as empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    done = assign(docs, ["doc_id", "text_crc32", "size"])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
