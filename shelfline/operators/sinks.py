"""Writes that survive a retry: entries before headers, whole snapshots, one partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_import(entries: DataFrame, header: DataFrame, path: str) -> None:
    """Appends entries, then their headers. Readers start from headers, so a half-written import is never seen."""
    entries.write.mode("append").partitionBy("import_id").parquet(f"{path}/entries")
    header.write.mode("append").parquet(f"{path}/imports")


def read_imports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, entries of the headers)."""
    headers = spark.read.parquet(f"{path}/imports")
    entries = spark.read.parquet(f"{path}/entries").withColumn("import_id", F.col("import_id").cast("string"))
    return headers, entries.join(headers.select("import_id"), "import_id", "left_semi")


def replace_chain(rows: DataFrame, path: str, column: str = "chain_name") -> None:
    """Overwrites only the partitions of the chains that `rows` holds; fails before writing if there are none."""
    if rows.isEmpty():
        raise ValueError("no rows to replace a chain with")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def snapshot(rows: DataFrame, root: str, version: int) -> str:
    """Writes a new version beside the old ones and returns its path; an interrupted write leaves the old ones whole."""
    path = f"{root}/v{version:08d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def append_deletion_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
