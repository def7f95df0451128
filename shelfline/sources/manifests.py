"""Several tables that change together: snapshots in folders of their own, and a manifest that names the current ones.

A save writes new snapshots, counts their rows again, and publishes a manifest under the next version's name, which exists
at most once. Readers follow the latest manifest, so they see all tables of a save or none; what a failed save wrote is in
no manifest. root: a folder that all machines share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Outdated(RuntimeError):
    """Another save came first."""


def _context(spark: SparkSession, path: str) -> tuple:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, root: str) -> int:
    """The latest published version; 0 without one."""
    _, at, fs = _context(spark, f"{root}/_versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def tables(spark: SparkSession, root: str, at: int | None = None) -> dict[str, dict]:
    """name to path and rows, of a version or the latest."""
    at = version(spark, root) if at is None else at
    if not at:
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/_versions/{at:08d}.json").collect()))  # a line for each table at most


def read(spark: SparkSession, root: str, name: str, at: int | None = None) -> DataFrame:
    return spark.read.parquet(tables(spark, root, at)[name]["path"])


def publish(spark: SparkSession, root: str, changed: dict[str, DataFrame], base: int) -> int:
    """Saves the tables as one new version after `base`, the version that they were made from; other tables stay as they are.

    Raises Outdated if another save was published since. Rows are counted in what was written, not in what was asked for.
    """
    if version(spark, root) != base:
        raise Outdated(f"version {base} is not the latest")
    new = tables(spark, root, base)
    for name, df in changed.items():
        path = f"{root}/{name}/{base + 1:08d}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        new[name] = {"path": path, "rows": spark.read.parquet(path).count()}
    jvm, pending, fs = _context(spark, f"{root}/_pending/{uuid.uuid4().hex}")
    out = fs.create(pending, False)
    out.write(bytearray(json.dumps(new, ensure_ascii=False, indent=0).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{base + 1:08d}.json")
    fs.mkdirs(final.getParent())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pending.toUri(), spark._jsc.hadoopConfiguration()) if pending.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    try:
        context.rename(pending, final, none)
    except Exception as e:
        fs.delete(pending, False)
        if fs.exists(final):
            raise Outdated(f"version {base + 1} was published meanwhile") from e
        raise
    return base + 1
