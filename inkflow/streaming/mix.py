"""A weighted mix of sources as their rows arrive: the same rows in the same order as the batch, whenever they come.

A pick of the schedule takes the next row of its source. The mix has come up to its frontier, the first pick whose source
has no row left; rows beyond wait in a queue. Queue and output are tables of one folder for each micro-batch, ranks and turns come
from prefix sums over keys, and what is carried over is a number or two for each source: no task holds a source, however hot it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.plans.lineage import cut
from inkflow.plans.sequence import prefix_sum
from inkflow.sources.mix import SEED, by_source, mix_weights, schedule
from inkflow.streaming.state import drop_folder, last_state, run_batches, state_before, write_state

#: Picks that are drawn beyond the expected ones before it is seen whether a source is empty.
SLACK = 1000


def _advance(spark: SparkSession, weights: dict[str, float], seen: dict[str, int], start: int, turned: dict[str, int], seed: int) -> tuple[DataFrame, int]:
    """Picks from ``start`` on, and the frontier that rows ``seen`` of each source bring the mix to."""
    used = {n: w for n, w in weights.items() if w > 0}
    total = sum(used.values())
    picks = int(min((seen[n] - turned[n]) * total / w for n, w in used.items()) * 1.05) + SLACK
    while True:
        plan = cut(schedule(spark, weights, picks, seed, start, turned))
        end = plan.where(F.col("turn") >= by_source(seen, weights)).agg(F.min("k")).first()[0]
        if end is not None:
            return plan, end
        picks *= 2


def _counts(d: DataFrame, source: str, weights: dict[str, float], before: dict[str, int]) -> dict[str, int]:
    """Rows of each source of the mix, added to those before."""
    new = {r[0]: r[1] for r in d.groupBy(source).count().collect()}
    return {n: before.get(n, 0) + new.get(n, 0) for n in weights}


def interleave_batch(batch: DataFrame, batch_id: int, weights: dict[str, float], path: str, seed: int = SEED, source: str = "source", order: str = "doc_id") -> None:
    """One micro-batch: its rows are queued by rank in their source, and what the frontier passes is written with its place ``k``."""
    spark = batch.sparkSession
    none = dict.fromkeys(weights, 0)
    held = state_before(spark, path, batch_id) or {"k": 0, "seen": none, "turned": none, "queued": {}}
    own = batch.where(F.col(source).isin(*weights))
    ranked = prefix_sum(own, order, F.lit(1), "_rank", by=(source,))
    ranked.withColumn("_rank", F.col("_rank") + by_source(held["seen"], weights, source)).write.mode("overwrite").parquet(f"{path}/queue/batch={batch_id}")
    queue = spark.read.parquet(f"{path}/queue/batch={batch_id}")
    seen = _counts(queue, source, weights, held["seen"])
    plan, end = _advance(spark, weights, seen, held["k"], held["turned"], seed)
    taken = plan.where(F.col("k") < end).select("k", F.col("source").alias("_s"), F.col("turn").alias("_turn"))
    turned = _counts(taken, "_s", weights, held["turned"])

    queued = {**held["queued"], str(batch_id): seen}  # the ranks that a folder's rows end before
    live = [b for b, ends in queued.items() if any(ends[n] > held["turned"][n] for n in weights)]
    passes: list[Column] = [(F.col(source) == n) & F.col("_rank").between(held["turned"][n], turned[n] - 1) for n in weights]
    # A folder holds the columns that its batch had.
    waiting = spark.read.option("mergeSchema", True).parquet(*[f"{path}/queue/batch={b}" for b in live]) if live else queue
    ready = waiting.where(reduce(Column.__or__, passes))
    out = ready.join(taken, (F.col(source) == F.col("_s")) & (F.col("_rank") == F.col("_turn"))).drop("_s", "_turn", "_rank")
    out.write.mode("overwrite").parquet(f"{path}/mixed/batch={batch_id}")
    write_state(spark, path, batch_id, {"k": end, "seen": seen, "turned": turned, "queued": {b: queued[b] for b in live}})
    for b in held["queued"]:  # what was empty when this batch began is not needed by a second run of it either
        if b not in live:
            drop_folder(spark, f"{path}/queue/batch={b}")


def interleave_to_parquet(stream: DataFrame, weights: dict[str, float], path: str, checkpoint: str, seed: int = SEED, source: str = "source", order: str = "doc_id") -> None:
    """Mixes what has arrived; called again, with the same checkpoint, it goes on with what came since.

    Rows of a source are taken in the order of arrival, by ``order`` within a micro-batch. Whatever the micro-batches, and however
    often the stream was stopped or a batch was repeated, ``read_mixed`` gives the rows of ``sources.mix.interleave`` over all rows until now
    that ends before the first pick that finds its source empty. Rows of no source of the mix are left out.
    """
    mix_weights(stream.sparkSession, weights)
    run_batches(stream, lambda batch, batch_id: interleave_batch(batch, batch_id, weights, path, seed, source, order), checkpoint)


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """The mix up to its frontier, with ``k``; what an unfinished batch has written is not seen."""
    held = last_state(spark, path)
    if held is None:
        raise ValueError(f"{path} holds no mix yet")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/mixed").where(F.col("batch") <= held["batch_id"]).drop("batch")
