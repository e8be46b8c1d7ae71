"""Cuts of lineage and folders for tables between jobs, both in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset a local master takes one of its own; a cluster raises an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get().rpartition("/")[0] if held.isDefined() else None
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or tempfile.mkdtemp(prefix="inkflow-")).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder; what follows starts from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
