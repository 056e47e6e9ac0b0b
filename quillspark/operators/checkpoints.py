"""The folder for checkpoints: the cluster's own, or in local mode a temporary one."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep spark.checkpoint.dir where it is set; set a temporary folder only in local mode."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
