"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone; every instant in the data model is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``checkpoint()``: the cluster's own setting, or a scratch folder where it names none (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        already = spark.sparkContext.getCheckpointDir()
        if already is not None:
            return already
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured
