"""Latest row wins, from a file stream: batches are appended to a table, and a reader keeps the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order` and then by its other columns; found by partial maxima, not by sorting a key's rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def ingest(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over the Parquet files of `source` that appends them to `table`; the sink's own log lets each batch count once."""
    return spark.readStream.schema(schema).parquet(source).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, schema: StructType, keys: list[str], order: list[str]) -> DataFrame:
    """The latest rows of what has been appended. Written to a new place, they can stand for the table from then on."""
    return latest(spark.read.schema(schema).parquet(table), keys, order)


def tumbling(events: DataFrame, time: str, every: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per window and key; rows later than `late` are dropped once their window is closed. Works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
