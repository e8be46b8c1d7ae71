"""Shards as a data source: windows, partitions, filters, and what is left when a task or the driver is killed."""

import os
import signal
import subprocess
import sys
import textwrap
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkflow.plans import sequence
from inkflow.sources import shard_source as source

ROOT = Path(__file__).resolve().parent.parent


def docs(spark, n, size=37):
    return spark.range(n).select((F.col("id") * size).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.col("id") * size + i).cast("int")).alias("ids"))


def files(path):
    return sorted(p.name for p in Path(path, "files").glob("*.parquet"))


@pytest.mark.parametrize(("block", "stride"), [(16, 16), (20, 7)])
def test_windows_of_shards(spark, tmp_path, block, stride):
    d, path = docs(spark, 100), str(tmp_path / "s")
    m = source.write_source(d, path, 600, block, {"a": (1, 2)})
    assert [x["rows"] for x in m["shards"]] == [600] * 6 + [100] and m["rows_written"] == 3700 and m["source"] == {"a": [1, 2]}
    got = source.read_source(spark, path, block, stride)
    want = sequence.windows(sequence.sharded(d, 600), block, stride, by=("shard_id",))
    assert got.rdd.getNumPartitions() == 7 and got.count() == want.count() > 100
    assert got.exceptAll(want.select(got.columns)).isEmpty()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no shards of this format"):
        source.read_source(spark, path, block + 1).count()


def test_filters_leave_shards_out(spark, tmp_path):
    path = str(tmp_path / "s")
    source.write_source(docs(spark, 100), path, 600, 16)
    for name in files(path):  # a shard that is not asked for need not even be there
        if name.startswith(("0-", "5-")):
            os.remove(f"{path}/files/{name}")
    key = source.PUSHDOWN
    held = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        for test, want in (("shard_id >= 1 AND shard_id < 5", {1, 2, 3, 4}), ("shard_id IN (2, 6)", {2, 6}), ("shard_id = 3 AND window_id < 2", {3}), ("shard_id > 5", {6})):
            got = source.read_source(spark, path, 16).where(test)
            assert got.rdd.getNumPartitions() == len(want) and {r[0] for r in got.select("shard_id").distinct().collect()} == want
        assert got.where("window_id < 2").count() == 2
    finally:
        spark.conf.set(key, held)


def test_shards_are_added(spark, tmp_path):
    path = str(tmp_path / "s")
    source.write_source(docs(spark, 100), path, 600, 16)
    m = source.write_source(docs(spark, 30), path, 600, 16, append=True)
    assert [x["rows"] for x in m["shards"]] == [600] * 6 + [100, 600, 510] and len(files(path)) == 9
    for wrong in ({"rows_per_shard": 601}, {"block": 8}, {"source": {"b": 1}}):
        with pytest.raises(ValueError, match="was written with"):
            source.write_source(docs(spark, 3), path, **({"rows_per_shard": 600, "block": 16, "append": True} | wrong))
    assert source.write_source(docs(spark, 3), path, 600, 16)["rows_written"] == 111 and len(files(path)) == 1
    gap = docs(spark, 3).where("start <> 37")
    with pytest.raises(Exception, match="do not begin where those before end"):
        source.write_source(gap, path, 600, 16)
    assert source.read_manifest(path)["rows_written"] == 111


def test_a_task_is_killed(spark, tmp_path):
    """The worker of the last shard dies: nothing of the write is left, and the shards before it are untouched."""
    path = str(tmp_path / "s")
    before = source.write_source(docs(spark, 20), path, 600, 16)
    held = files(path)

    def dies(batches):
        for b in batches:
            if max(b.column(0).to_pylist(), default=0) >= 35 * 37:
                os.kill(os.getpid(), signal.SIGKILL)
            yield b

    d = docs(spark, 40)
    with pytest.raises(Exception):  # noqa: B017
        source.write_source(d.mapInArrow(dies, d.schema), path, 600, 16, append=True)
    assert source.read_manifest(path) == before and files(path) == held


def test_the_driver_is_killed_before_the_commit(spark, tmp_path):
    """Files without a manifest are no shards; the next run takes their place."""
    path, mark = str(tmp_path / "s"), str(tmp_path / "written")
    script = textwrap.dedent(f"""
        import sys, time, pathlib
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession, functions as F
        from inkflow.sources import shard_source as source

        class Slow(source.ShardWriter):
            def commit(self, messages):
                pathlib.Path({mark!r}).write_text("all files are there")
                time.sleep(600)

        class SlowShards(source.TokenShards):
            def writer(self, schema, overwrite):
                w = super().writer(schema, overwrite)
                return Slow(w.path, w.overwrite, w.settings)

        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        spark.dataSource.register(SlowShards)
        d = spark.range(2).select(F.col("id").alias("shard_id"), F.lit(0).cast("long").alias("start"), F.array(F.lit(1)).alias("ids"))
        d.coalesce(1).write.format("token_shards").option("rows_per_shard", 1).option("block", 16).mode("overwrite").save({path!r})
    """)
    p = subprocess.Popen([sys.executable, "-c", script], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        for _ in range(600):
            if os.path.exists(mark) or p.poll() is not None:
                break
            time.sleep(0.2)
        assert os.path.exists(mark) and len(files(path)) == 2
    finally:
        os.killpg(p.pid, signal.SIGKILL)
        p.wait()
    with pytest.raises(Exception, match="no shards of this format"):
        source.read_source(spark, path, 16).count()
    m = source.write_source(docs(spark, 20), path, 600, 16)
    assert len(files(path)) == len(m["shards"]) == 2 and source.read_source(spark, path, 16).count() == 37 + 8
