"""Intermediate results that several later steps read, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df after a checkpoint in the folder of spark.checkpoint.dir: later steps neither plan nor compute it again, and a lost
    executor takes nothing along. Where the setting is missing, a session in one process makes a folder of its own and a
    cluster raises.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
