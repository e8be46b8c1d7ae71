"""Weighted interleaving of sources by a seeded schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.plans.sequence import prefix_sum
from inkflow.sources.readers import hash_unit

SEED, SAMPLE = 67, 10_000


def mix_weights(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """(ord, source, weight, probability); weights that add up to nothing are an error."""
    if sum(weights.values()) <= 0:
        raise ValueError("the weights of a mix must add up to more than 0")
    total = sum(weights.values())
    return spark.createDataFrame([(i, n, float(w), w / total) for i, (n, w) in enumerate(weights.items())], "ord int, source string, weight double, probability double")


def schedule(spark: SparkSession, weights: dict[str, float], picks: int, seed: int = SEED, start: int = 0, turned: dict[str, int] | None = None) -> DataFrame:
    """(k, source, turn): the source of each pick, by a hash of seed and pick, and the how-manieth of that source it is.

    ``picks`` picks from ``start`` on; ``turned`` is how often each source was picked before.
    """
    mix_weights(spark, weights)
    total, at, source = sum(weights.values()), 0.0, F.lit(None).cast("string")
    u = hash_unit(seed, F.col("k"))
    bounds = []
    for n, w in weights.items():
        at += w / total
        bounds.append((n, at))
    for n, bound in reversed(bounds):
        source = F.when(u < bound, F.lit(n)).otherwise(source)
    last = next(n for n, w in reversed(weights.items()) if w > 0)
    k = spark.range(start, start + picks).select(F.col("id").alias("k")).withColumn("source", F.coalesce(source, F.lit(last)))
    turns = prefix_sum(k, "k", F.lit(1), "turn", by=("source",))
    return turns.withColumn("turn", F.col("turn") + by_source(turned, weights)) if turned else turns


def by_source(numbers: dict[str, int], weights: dict[str, float], source: str = "source") -> Column:
    """The number of the row's source; a mix has few sources, so they are literals."""
    return F.create_map(*[x for n in weights for x in (F.lit(n), F.lit(numbers.get(n, 0)).cast("long"))])[F.col(source)]


def interleave(docs: DataFrame, weights: dict[str, float], seed: int = SEED, stop: str = "first_exhausted", source: str = "source", order: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with ``k``, their place in the mix.

    ``first_exhausted`` ends before the first pick that finds its source empty. ``all_exhausted`` starts a source
    anew when it is empty, until each has been through once.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(stop)
    spark = docs.sparkSession
    own = docs.where(F.col(source).isin(*weights)).withColumn("_source", F.col(source))
    sizes = {r[0]: r[1] for r in own.groupBy("_source").count().collect()}  # one row per source of the mix
    used = {n: w for n, w in weights.items() if w > 0}
    total = sum(used.values())
    need = [sizes.get(n, 0) * total / w for n, w in used.items()]
    picks = int((min if stop == "first_exhausted" else max)(need) * 1.05) + 1000
    while True:
        plan = schedule(spark, weights, picks, seed)
        n = by_source(sizes, weights)
        if stop == "first_exhausted":
            end = plan.where(F.col("turn") >= n).agg(F.min("k")).first()[0]
        else:
            ends = [r[0] for r in plan.where(F.col("turn") == n - 1).select("k").collect()]
            end = max(ends) + 1 if len(ends) == sum(1 for k in used if sizes.get(k)) else None
        if end is not None:
            break
        picks *= 2
    plan = plan.where(F.col("k") < end)
    plan = plan.select("k", F.col("source").alias("_s"), (F.pmod("turn", n) if stop == "all_exhausted" else F.col("turn")).alias("_turn"))
    ranked = prefix_sum(own, order, F.lit(1), "_rank", by=("_source",))
    out = ranked.join(plan, (F.col("_source") == F.col("_s")) & (F.col("_rank") == F.col("_turn")))
    return out.drop("_source", "_s", "_turn", "_rank")


def sample_quota(spark: SparkSession, weights: dict[str, float], sample: int = SAMPLE) -> DataFrame:
    """(source, quota): documents to sample of each source; halves round to even, one at least."""
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(sample)) * F.col("weight") / F.lit(float(sum(weights.values()))))).cast("long")
    return mix_weights(spark, weights).select("source", quota.alias("quota"))
