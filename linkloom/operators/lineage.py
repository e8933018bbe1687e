"""Cutting the lineage of frames that a run uses more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the folder that ``spark.checkpoint.dir`` names (a temporary one where a local session leaves it unset)."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="linkloom-"))
    return df.checkpoint()
