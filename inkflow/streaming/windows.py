"""Count windows over a stream of documents, with the tail of ids carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.functions.encode import encoder, framed, n_tokens
from inkflow.functions.text import clean
from inkflow.plans import sequence
from inkflow.streaming.state import drop_folder, last_state, run_batches, state_before, write_state


def stream_windows(docs: DataFrame, block: int = 256, stride: int = 256, shards: int = 1) -> DataFrame:
    """A stream ``docs(doc_id, text)`` -> (shard, window_id, x, target), in append mode.

    Documents are dealt to ``shards`` by id, each of which is a sequence of its own in the order of arrival, by id
    within a micro-batch. State of a shard: the ids that no window has passed yet, and the number of the next window.
    """
    if stride > block:
        raise ValueError("a stride above the block would lose what lies between windows")
    ids = docs.select(F.pmod("doc_id", F.lit(shards)).cast("int").alias("shard"), "doc_id", framed(encoder()(F.col("doc_id"), clean(F.col("text")))).alias("ids"))

    def carry(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, n = state.get if state.exists else (b"", 0)
        new = pd.concat(list(pdfs)).sort_values("doc_id")
        held = np.concatenate([np.frombuffer(tail, np.int32), *(np.asarray(x, np.int32) for x in new["ids"])])
        count = max(0, (len(held) - block - 1) // stride + 1)
        state.update((held[count * stride :].tobytes(), n + count))
        for at in range(0, count, 256):
            part = range(at, min(count, at + 256))
            yield pd.DataFrame({"shard": key[0], "window_id": [n + i for i in part], "x": [held[i * stride : i * stride + block] for i in part], "target": [held[i * stride + 1 : i * stride + block + 1] for i in part]})

    return ids.groupBy("shard").applyInPandasWithState(carry, "shard int, window_id long, x array<int>, target array<int>", "tail binary, n long", "append", "NoTimeout")


def windows_of_batch(batch: DataFrame, batch_id: int, path: str, block: int = 256, stride: int = 256, shards: int = 1) -> None:
    """One micro-batch: its ids go on where those of the batch before ended, and what no window has passed yet is kept for the next.

    Positions come from a prefix sum over ids and lengths, windows from slices that documents lend them, so a shard is spread over tasks like a
    table is: no task holds what a micro-batch brings to a shard. The tail is less than a block and a stride of ids for each shard.
    """
    if stride > block:
        raise ValueError("a stride above the block would lose what lies between windows")
    spark = batch.sparkSession
    held = state_before(spark, path, batch_id) or {"ids": [0] * shards, "ends": []}
    before = held["ids"]
    number = lambda of: F.element_at(F.array(*[F.lit(x).cast("long") for x in of]), F.col("shard") + 1)
    d = batch.select(F.coalesce(F.pmod("doc_id", F.lit(shards)), F.lit(0)).cast("int").alias("shard"), "doc_id", clean(F.col("text")).alias("text")).withColumn("n", n_tokens(F.col("text")))
    new = {r[0]: r[1] for r in d.groupBy("shard").agg(F.sum("n")).collect()}
    ids = [x + new.get(i, 0) for i, x in enumerate(before)]
    passed = [max(0, (x - block - 1) // stride + 1) for x in ids]
    d = sequence.prefix_sum(d, "doc_id", F.col("n"), "start", by=("shard",)).withColumn("start", F.col("start") + number(before))
    encoded = lambda rows: rows.select("shard", "start", framed(encoder()(F.col("doc_id"), F.col("text"))).alias("ids"))
    rows, late = encoded(d), encoded(d.where(F.col("start") + F.col("n") > number(passed) * stride))
    if batch_id:
        tail = spark.read.parquet(f"{path}/tail/batch={batch_id - 1}")
        rows, late = rows.union(tail), late.union(tail)
    sequence.windows(rows, block, stride, by=("shard",)).write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")
    skip = F.greatest(F.lit(0).cast("long"), number(passed) * stride - F.col("start"))
    late = late.where(F.col("start") + F.size("ids") > number(passed) * stride)
    late = late.select("shard", (F.col("start") + skip).alias("start"), F.slice("ids", skip.cast("int") + 1, F.size("ids")).alias("ids"))
    late.repartition(1).write.mode("overwrite").parquet(f"{path}/tail/batch={batch_id}")
    write_state(spark, path, batch_id, {"ids": ids, "ends": [*held["ends"], sum(passed)]})
    drop_folder(spark, f"{path}/tail/batch={batch_id - 2}")


def stream_to_windows(stream: DataFrame, path: str, checkpoint: str, block: int = 256, stride: int = 256, shards: int = 1) -> None:
    """Windows of everything that has arrived, in the order of arrival and by id within a micro-batch; called again it goes on.

    However the micro-batches fall, wherever the stream was stopped and whichever batch was repeated, the windows are those of one sequence
    for each shard.
    """
    run_batches(stream, lambda batch, batch_id: windows_of_batch(batch, batch_id, path, block, stride, shards), checkpoint)


def read_windows(spark: SparkSession, path: str, step: int = 0, per_step: int = 128) -> DataFrame:
    """(shard, window_id, x, target) after ``step`` steps of ``per_step`` windows, for a training run that resumes there.

    With one shard folders of batches that end before that are not read; with more a step takes its share of each shard.
    """
    held = last_state(spark, path)
    if held is None:
        raise ValueError(f"{path} holds no windows yet")
    shards, skip = len(held["ids"]), step * per_step
    first = next((b for b, end in enumerate(held["ends"]) if end > skip), len(held["ends"])) if shards == 1 else 0
    w = spark.read.parquet(f"{path}/windows").where(F.col("batch").between(first, held["batch_id"])).drop("batch")
    return w.where(F.col("window_id") * shards + F.col("shard") >= skip) if step else w


def stream_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, exactly once: the sink's log and the checkpoint decide what was done."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def stream_to_shards(stream: DataFrame, path: str, checkpoint: str, per_shard: int) -> None:
    """Micro-batches of ``stream(pos, output_id)`` as shard folders; a batch that runs again overwrites its own folder."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("shard_id", F.floor(F.col("pos") / per_shard)).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
