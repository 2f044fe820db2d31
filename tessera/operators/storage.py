"""Rows that several steps read: computed once and kept where every executor finds them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which driver and executors share; a local session without one (a test, a bench) gets a folder under /tmp."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(shared)
    return (shared or sc.getCheckpointDir()).rstrip("/")


def kept(rows: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()
