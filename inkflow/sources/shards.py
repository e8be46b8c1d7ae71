"""Token shards and caches as Parquet, with a manifest that a later run can check and resume from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.plans.sequence import sharded, windows

FORMAT, ROW_BYTES = 1, 12


def rows_per_shard(megabytes: int = 256) -> int:
    return max(1, megabytes * 2**20 // ROW_BYTES)


def most_rows(gigabytes: int = 50) -> int:
    return gigabytes * 2**30 // ROW_BYTES


def _file(spark: SparkSession, path: str):
    """Hadoop's file system, so that any store that Spark reads holds the small JSON files too."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: dict | list, ordered: bool = False) -> None:
    """Written beside, then renamed over the old file in one step: a reader finds the old value or the new one. Keys are sorted unless they are ``ordered``."""
    fs, p = _file(spark, path)
    _, beside = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, sort_keys=not ordered, ensure_ascii=False).encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    to = fs.makeQualified(p)
    hadoop.FileContext.getFileContext(to.toUri(), fs.getConf()).rename(fs.makeQualified(beside), to, over)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _file(spark, path)
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if fs.exists(p) else None


def canonical(value):
    """Nested settings in a form that compares and serialises alike: sorted keys, lists for tuples."""
    return json.loads(json.dumps(value, sort_keys=True, default=list))


def write_shards(docs: DataFrame, path: str, per_shard: int, block: int = 256, source: dict | None = None, first_shard: int = 0, most: int | None = None, max_rows: int | None = None) -> dict:
    """Writes ``docs(start, ids)`` below ``path`` as shard_id=N, all complete but the last, and its manifest.

    A later call starts new shards at ``first_shard``; rows from ``most`` on are left out. ``max_rows`` is noted, else ``most``.
    Shards from ``first_shard`` on that an interrupted call left behind, which no manifest names, are removed first.
    """
    spark = docs.sparkSession
    if most is not None:
        docs = docs.where(F.col("start") < most).withColumn("ids", F.slice("ids", 1, F.least(F.size("ids").cast("long"), F.lit(most) - F.col("start")).cast("int")))
    s = sharded(docs, per_shard).withColumn("shard_id", F.col("shard_id") + first_shard)
    drop_shards(spark, path, first_shard)
    s.repartition("shard_id").sortWithinPartitions("shard_id", "start").write.mode("append" if first_shard else "overwrite").partitionBy("shard_id").parquet(f"{path}/tokens")
    made = spark.read.parquet(f"{path}/tokens").groupBy("shard_id").agg(F.sum(F.size("ids")).cast("long").alias("rows")).orderBy("shard_id")
    shards = [{"shard_id": r["shard_id"], "rows": r["rows"]} for r in made.collect()]
    manifest = {"format_version": FORMAT, "block_size": block, "rows_per_shard": per_shard, "max_rows": max_rows if max_rows is not None else most, "rows_written": sum(x["rows"] for x in shards), "shards": shards, "source": canonical(source or {})}
    write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def drop_shards(spark: SparkSession, path: str, first: int) -> None:
    """Removes the folders of the shards from ``first`` on."""
    fs, p = _file(spark, f"{path}/tokens")
    for x in fs.listStatus(p) if fs.exists(p) else ():
        kind, _, number = x.getPath().getName().partition("=")
        if kind == "shard_id" and int(number) >= first:
            fs.delete(x.getPath(), True)


def resume(spark: SparkSession, path: str, per_shard: int, block: int = 256, source: dict | None = None) -> dict | None:
    """The manifest of an earlier run, or None; one of another format, block, shard size or source is an error."""
    m = read_json(spark, f"{path}/manifest.json")
    if m is None:
        return None
    for key, want in (("format_version", FORMAT), ("block_size", block), ("rows_per_shard", per_shard), ("source", canonical(source or {}))):
        if m[key] != want:
            raise ValueError(f"{path} was written with {key} {m[key]!r}, not {want!r}")
    return m


def read_shards(spark: SparkSession, path: str, first: int = 0, stop: int | None = None, block: int = 256, stride: int = 256) -> DataFrame:
    """Windows of the shards from ``first`` up to ``stop``, none across a border; partitions outside are not read."""
    m = read_json(spark, f"{path}/manifest.json")
    if m is None or m["format_version"] != FORMAT or m["block_size"] != block:
        raise ValueError(f"{path} holds no shards of this format and block")
    chosen = [s for s in m["shards"] if first <= s["shard_id"] and (stop is None or s["shard_id"] < stop)]
    if not chosen:
        raise ValueError("no shard is chosen")
    s = spark.read.parquet(f"{path}/tokens").where(F.col("shard_id").between(chosen[0]["shard_id"], chosen[-1]["shard_id"]))
    return windows(s, block, stride, by=("shard_id",))


def write_cache(docs: DataFrame, path: str, meta: dict) -> None:
    """``docs(start, ids)`` as a cache with what it was made from and the number of its ids."""
    docs.write.mode("overwrite").parquet(f"{path}/data")
    spark = docs.sparkSession
    rows = spark.read.parquet(f"{path}/data").agg(F.sum(F.size("ids")).cast("long")).first()[0] or 0
    write_json(spark, f"{path}/meta.json", {"made_from": canonical(meta), "rows": rows})


def read_cache(spark: SparkSession, path: str, meta: dict, split: str | None = None) -> DataFrame | None:
    """The cache if it was made from the same; one without meta counts for no split and for train only.

    A cache that is incomplete, or of another length than was noted, is none.
    """
    fs, data = _file(spark, f"{path}/data/_SUCCESS")
    if not fs.exists(data):
        return None
    held, cache = read_json(spark, f"{path}/meta.json"), spark.read.parquet(f"{path}/data")
    if held is None:
        return cache if split in (None, "train") else None
    if held["made_from"] != canonical(meta) or held["rows"] != (cache.agg(F.sum(F.size("ids"))).first()[0] or 0):
        return None
    return cache


def write_vocabulary(spark: SparkSession, path: str, words: list[str]) -> None:
    write_json(spark, path, {"words": words})


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    return (read_json(spark, path) or {"words": []})["words"]
