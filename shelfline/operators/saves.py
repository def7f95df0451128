"""Saving parsed order files: new orders and lines, or the file's reference alone where an order has moved on.

files: file_id, client_id, supplier_id, file_name, path (null if the file is not kept), operator_name, at. orders: file_id, id,
order_no and further columns; lines: order_id (the new order's id) and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .imports import latest, upsert

KEY = ["client_id", "supplier_id", "order_no"]


def outcomes(files: DataFrame, orders: DataFrame, current: DataFrame) -> DataFrame:
    """file_id, outcome: saved; attached if one of its orders is past import and the file is kept; refused if it is not kept."""
    mine = orders.select("file_id", "order_no").distinct().join(files, "file_id")
    past = mine.join(current.where("status <> 'imported'").select(*KEY), KEY, "left_semi").select("file_id", F.lit(True).alias("past")).distinct()
    outcome = F.when(F.col("past").isNull(), "saved").when(F.coalesce("path", F.lit("")) != "", "attached").otherwise("refused")
    return files.join(past, "file_id", "left").select("file_id", outcome.alias("outcome"))


def saved(files: DataFrame, orders: DataFrame, lines: DataFrame, current_orders: DataFrame, current_lines: DataFrame, batches: DataFrame) -> dict[str, DataFrame]:
    """Snapshots of orders, order_lines and import_batches after the files were saved, to be published together.

    A saved file's orders replace imported ones of their client, supplier and number under the old id, with their lines; of two
    files with one order the later counts. An attached file leaves its reference on its orders that are past import and
    nothing else. Both leave a batch; a refused file leaves nothing. An order keeps its path where the file brings none.
    """
    told = files.join(outcomes(files, orders, current_orders), "file_id")
    mine = orders.join(told.where("outcome = 'saved'").select("file_id", "client_id", "supplier_id", F.col("file_name").alias("source_file"), "path", "at"), "file_id")
    mine = latest(mine, [F.col(k) for k in KEY], [F.desc("at"), F.desc("file_id"), F.desc("id")])
    old = current_orders.select(*KEY, F.col("id").alias("_id"), F.col("source_file_path").alias("_path"))
    own = mine.join(old, KEY, "left").withColumn("new_id", F.col("id")).withColumn("id", F.coalesce("_id", "id"))
    own = own.withColumn("source_file_path", F.coalesce(F.nullif("path", F.lit("")), "_path")).withColumn("status", F.lit("imported"))
    named = own.select(*[c for c in current_orders.columns if c in own.columns])
    held = told.where("outcome = 'attached'").join(orders.select("file_id", "order_no"), "file_id")
    held = latest(held, [F.col(k) for k in KEY], [F.desc("at"), F.desc("file_id")]).select(*KEY, F.col("file_name").alias("_file"), F.col("path").alias("_p"))
    kept = current_orders.join(held, KEY, "left").withColumn("_on", F.col("_p").isNotNull() & (F.col("status") != "imported"))
    kept = kept.withColumn("source_file", F.when(F.col("_on"), F.col("_file")).otherwise(F.col("source_file"))).withColumn("source_file_path", F.when(F.col("_on"), F.col("_p")).otherwise(F.col("source_file_path")))
    kept = kept.select(*current_orders.columns)
    ids = own.select(F.col("new_id").alias("order_id"), F.col("id").alias("_id"))
    new_lines = lines.join(ids, "order_id").withColumn("order_id", F.col("_id")).drop("_id")
    rest = current_lines.join(own.select(F.col("id").alias("order_id")), "order_id", "left_anti")
    left = told.where("outcome <> 'refused'").select("client_id", "supplier_id", "file_name", F.lit("saved").alias("status"), F.col("path").alias("file_storage_path"), "operator_name", F.col("at").alias("imported_at"))
    return {"orders": upsert(kept, named, KEY).select(*current_orders.columns), "order_lines": rest.unionByName(new_lines, allowMissingColumns=True), "import_batches": batches.unionByName(left, allowMissingColumns=True)}
