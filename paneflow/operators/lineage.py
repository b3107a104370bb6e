"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint, in the folder that the cluster names in spark.checkpoint.dir.

    Where none is named, one machine uses a temporary folder, as in tests; on a cluster that is an error, as executors would write
    to folders that others don't see.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paneflow-"))
    return df.checkpoint()
