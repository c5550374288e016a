"""Cutting lineage in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read back from spark.checkpoint.dir; where that is unset, from a local folder for a local master (tests), and an error for any other."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/roadweave-checkpoints")
    return df.checkpoint()
