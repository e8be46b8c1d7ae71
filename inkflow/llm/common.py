"""What the operators share: tables, lineage cuts, word splitting and connected components."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch for stages that read whole texts: long texts then fit a worker's memory.
TEXT_ROWS = 256
#: Rows of two numbers that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """All operators set the same size, so that it makes no difference which of them was called last before a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def text_hash(text: Column) -> Column:
    """What a row's text is known by, beside its id; null is unlike the empty text."""
    return F.xxhash64(text, text.isNull())


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder that the session names in spark.checkpoint.dir.

    Where that is unset, a temporary folder is taken on a single machine (a local master); a cluster raises an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="inkflow-"))
    return df.checkpoint()


def seeded(seed: int, *columns) -> F.Column:
    """A 48-bit integer from md5 of the seed and the columns; any SQL engine with md5 can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (both of one orderable type) -> (node, root), root the least node.

    Rounds of contraction: every node points to its least neighbour, pointers are doubled until they end in nodes
    that point to none, and edges are rewritten to those; repeated and closed ones are dropped. Each tree holds two
    nodes or more, so rounds and doublings grow with the logarithm of the nodes. No round holds a neighbour list, and hubs only meet in
    partial minima and in joins against one row per node. Nulls are ignored; no edges give an empty result.
    """
    e = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")))
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        parent = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        while True:
            jumped = parent.join(parent.toDF("p", "pp"), "p").select("a", "p", "pp")
            jumped = cut(jumped)
            parent = jumped.select("a", F.col("pp").alias("p"))
            if jumped.where("p <> pp").isEmpty():
                break
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        e = cut(e.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        labels = cut(labels.join(parent.toDF("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
    return labels


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
