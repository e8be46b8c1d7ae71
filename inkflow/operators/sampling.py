"""Next-token sampling over ``logits(step, output_id, logit)``: masks, penalties, top-k, softmax, draws and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.sources.readers import hash_unit

#: Output ids that are never drawn: padding, unknown and begin marks, and the first and last byte token.
BANNED, BYTES = (0, 1, 2), (101, 356)
EOS_ID = 3
NEVER = float("-inf")


def banned(logits: DataFrame, ids=BANNED, byte_tokens: bool = True) -> DataFrame:
    hit = F.col("output_id").isin(*ids)
    if byte_tokens:
        hit = hit | F.col("output_id").between(*BYTES)
    return logits.withColumn("logit", F.when(hit, F.lit(NEVER)).otherwise(F.col("logit").cast("double")))


def repetition_penalty(logits: DataFrame, generated: DataFrame, penalty: float = 1.15) -> DataFrame:
    """Ids in ``generated(step, output_id)`` lose: positive logits are divided, others multiplied."""
    seen = generated.select("step", "output_id").distinct().withColumn("_seen", F.lit(True))
    out = logits.join(seen, ["step", "output_id"], "left")
    damped = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return out.withColumn("logit", F.when(F.col("_seen"), damped).otherwise(F.col("logit"))).drop("_seen")


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Keeps logits down to the k-th value, ties with it too; off unless 0 < k < number of ids."""
    if k <= 0:
        return logits
    step = Window.partitionBy("step")
    rank = F.rank().over(step.orderBy(F.col("logit").desc()))
    out = logits.withColumns({"_rank": rank, "_n": F.count(F.lit(1)).over(step)})
    return out.withColumn("logit", F.when((F.col("_rank") <= k) | (F.col("_n") <= k), F.col("logit")).otherwise(F.lit(NEVER))).drop("_rank", "_n")


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    step = Window.partitionBy("step")
    scaled = F.col("logit") / temperature
    e = logits.withColumn("_e", F.exp(scaled - F.max(scaled).over(step)))
    return e.withColumn("prob", F.col("_e") / F.sum("_e").over(step)).drop("_e")


def greedy(logits: DataFrame) -> DataFrame:
    """(step, output_id): the largest logit, of equal ones the least id."""
    best = F.max_by("output_id", F.struct("logit", -F.col("output_id")))
    return logits.groupBy("step").agg(best.alias("output_id"))


def draw(probs: DataFrame, seed: int = 67) -> DataFrame:
    """(step, output_id) by inverse distribution: the first id at which the sum of probabilities passes a hash of seed and step."""
    upto = F.sum("prob").over(Window.partitionBy("step").orderBy("output_id").rowsBetween(Window.unboundedPreceding, 0))
    held = probs.where("prob > 0").withColumns({"_upto": upto, "_u": hash_unit(seed, F.col("step"))})
    return held.groupBy("step").agg(F.coalesce(F.min(F.when(F.col("_upto") > F.col("_u"), F.col("output_id"))), F.max("output_id")).alias("output_id"))


def pick(logits: DataFrame, strategy: str = "greedy", temperature: float = 1.0, seed: int = 67) -> DataFrame:
    if strategy == "greedy":
        return greedy(logits)
    if strategy in ("sample", "top_k"):
        return draw(softmax(logits, temperature), seed)
    raise ValueError(f"strategy {strategy!r}")


def until_eos(sequence: DataFrame, key: str = "seq", pos: str = "pos", most: int | None = None) -> DataFrame:
    """Tokens before the first end mark of each sequence, ``most`` of them at most."""
    first = F.min(F.when(F.col("output_id") == EOS_ID, F.col(pos))).over(Window.partitionBy(key))
    out = sequence.withColumn("_end", first).where(F.col("_end").isNull() | (F.col(pos) < F.col("_end"))).drop("_end")
    return out.where(F.col(pos) < most) if most is not None else out


def filtered(logits: DataFrame, generated: DataFrame, penalty: float = 1.15, k: int = 50, byte_tokens: bool = True) -> DataFrame:
    """All filters in their order: bans, byte tokens, penalty, top-k."""
    return top_k(repetition_penalty(banned(logits, byte_tokens=byte_tokens), generated, penalty), k)


def cross_entropy(logits: DataFrame, targets: DataFrame, ignore: int = -100) -> DataFrame:
    """One row: mean of logsumexp - logit[target] over ``targets(step, target)`` that are not ignored; none: null."""
    step = Window.partitionBy("step")
    m = F.max("logit").over(step)
    l = logits.withColumns({"_m": m, "logit": F.col("logit").cast("double")}).withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    t = targets.where(F.col("target") != ignore).select("step", "target")
    per = l.join(t, "step").groupBy("step").agg((F.log(F.sum("_e")) + F.max("_m") - F.max(F.when(F.col("output_id") == F.col("target"), F.col("logit")))).alias("loss"))
    return per.agg(F.avg("loss").alias("loss"))


def sampled_cross_entropy(logits: DataFrame, targets: DataFrame, sampled: DataFrame, ignore: int = -100) -> DataFrame:
    """The same over ``sampled(output_id)`` and all targets only, the largest vocabulary being too wide to sum over."""
    used = targets.where(F.col("target") != ignore).select(F.col("target").alias("output_id")).union(sampled.select("output_id")).distinct()
    return cross_entropy(logits.join(used, "output_id", "left_semi"), targets, ignore)


def target_index(targets: DataFrame) -> DataFrame:
    """(step, target, index): the place of each target among the distinct ones, from 0."""
    distinct = targets.select("target").distinct().withColumn("index", F.row_number().over(Window.orderBy("target")) - 1)
    return targets.join(distinct, "target").select("step", "target", "index")


def learning_rate(step: Column, total: int, rate: float = 3e-4) -> Column:
    """Cosine from the whole rate down to a tenth; without steps the rate itself."""
    return F.lit(rate) if total <= 0 else rate * (0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * step / total)))


def step_flags(steps: DataFrame, accumulate: int = 8, log_every: int = 1000, save_every: int = 5000) -> DataFrame:
    """``steps(batch)`` with global_step, and whether the batch ends an update, a log interval, a checkpoint interval."""
    ends = (F.col("batch") + 1) % accumulate == 0
    step = F.floor((F.col("batch") + 1) / accumulate)
    return steps.select("batch", step.alias("global_step"), ends.alias("updates"), (ends & (step % log_every == 0)).alias("logs"), (ends & (step % save_every == 0)).alias("saves"))


def mean_of_batches(losses: DataFrame, most: int) -> DataFrame:
    """One row: the mean of the batches' mean losses over the first ``most`` of ``losses(batch_id, loss)``."""
    per = losses.where(F.col("batch_id") < most).groupBy("batch_id").agg(F.avg("loss").alias("loss"))
    return per.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


def interval_means(losses: DataFrame, every: int) -> DataFrame:
    """(interval, loss): the mean of each logging interval of ``losses(step, loss)``."""
    return losses.groupBy(F.floor(F.col("step") / every).alias("interval")).agg(F.avg("loss").alias("loss"))


def best_so_far(losses: DataFrame) -> DataFrame:
    """``losses(step, loss)`` with the least loss so far and whether the step improved on it. One row per validation."""
    w = Window.orderBy("step")
    before = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return losses.select("step", "loss", F.least("loss", before).alias("best"), (before.isNull() | (F.col("loss") < before)).alias("improved"))
