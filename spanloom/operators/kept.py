"""Tables that are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """Computed once and cut from its lineage, in the folder of spark.checkpoint.dir (one of
    its own only where none is set and all runs in one process)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanloom-"))
    return df.checkpoint()
