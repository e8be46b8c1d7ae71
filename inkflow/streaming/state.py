"""What a stream carries from one micro-batch to the next, where it is a table: numbers in JSON, one file for each batch.

A micro-batch reads the state of the one before and writes its own last. Its tables are folders of its own that a second
run overwrites, so a batch that failed, or whose commit was lost, is repeated from the same state with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkflow.sources.shards import _file, read_json, write_json


def state_before(spark: SparkSession, path: str, batch_id: int) -> dict | None:
    """The state that batch ``batch_id`` starts from; None before the first one, and a state that is gone is an error."""
    if batch_id == 0:
        return None
    held = read_json(spark, f"{path}/state/{batch_id - 1}.json")
    if held is None:
        raise ValueError(f"{path} holds no state of batch {batch_id - 1}")
    return held


def write_state(spark: SparkSession, path: str, batch_id: int, state: dict) -> None:
    """Notes the state after ``batch_id``, and then that it is the last one."""
    write_json(spark, f"{path}/state/{batch_id}.json", state)
    write_json(spark, f"{path}/state/last.json", {"batch_id": batch_id, **state})


def last_state(spark: SparkSession, path: str) -> dict | None:
    return read_json(spark, f"{path}/state/last.json")


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def run_batches(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, batch by batch, through ``save``."""
    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
