"""Array arithmetic of the model, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.plans.lineage import cut
from inkflow.plans.sequence import prefix_sum

EPS, THETA = 1e-6, 1e5
#: Output rows that a task multiplies by at once, and vectors in a product.
BLOCK_ROWS, BATCH = 4096, 256


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def rms_norm(a: Column, weight: Column | None = None, eps: float = EPS) -> Column:
    """x / sqrt(mean of squares + eps), times a weight per component."""
    d = doubles(a)
    scale = F.sqrt(total(F.transform(d, lambda x: x * x)) / F.size(a) + eps)
    out = F.transform(d, lambda x: x / scale)
    return out if weight is None else F.zip_with(out, doubles(weight), lambda x, w: x * w)


def rotary(a: Column, pos: Column, theta: float = THETA) -> Column:
    """Turns each (even, odd) pair of components by the angle pos / theta^(2 i / size)."""
    pairs = F.sequence(F.lit(0), (F.size(a) / 2 - 1).cast("int"))

    def turned(i):
        angle = pos / F.pow(F.lit(theta), 2 * i / F.size(a))
        x, y = F.get(a, 2 * i).cast("double"), F.get(a, 2 * i + 1).cast("double")
        return F.array(x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle))

    return F.flatten(F.transform(pairs, turned))


def logits(vectors: DataFrame, outputs: DataFrame, key: str, vector: str, block: int = BLOCK_ROWS) -> DataFrame:
    """(key, output_id, logit): the product of each vector and each row of ``outputs(output_id, row)``, in double precision.

    Output rows come in blocks that a broadcast holds, each block in one pass over the vectors; null vectors have no logits.
    """
    numbered = cut(prefix_sum(outputs.where("row is not null"), "output_id", F.lit(1), "_pos").select("output_id", "row", F.floor(F.col("_pos") / block).alias("_block")))
    last = numbered.agg(F.max("_block")).first()[0]
    held = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    kind = f"{key} {held.schema[key].dataType.simpleString()}, output_id {numbered.schema['output_id'].dataType.simpleString()}, logit double"

    def product(k: int) -> DataFrame:
        rows = numbered.where(F.col("_block") == k).toArrow()
        of_id = rows["output_id"].type
        shared = vectors.sparkSession.sparkContext.broadcast((rows["output_id"].to_pylist(), np.array(rows["row"].to_pylist(), np.float64)))

        def run(batches):
            ids, matrix = shared.value
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    part = b.slice(at, BATCH)
                    out = np.array(part.column(1).to_pylist(), np.float64) @ matrix.T
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(out)), len(ids)))), pa.array(ids * len(out), of_id), pa.array(out.ravel())], [key, "output_id", "logit"])

        return held.mapInArrow(run, kind)

    parts = [product(k) for k in range(0 if last is None else last + 1)]
    if not parts:
        return held.select(key, F.lit(None).cast(numbered.schema["output_id"].dataType).alias("output_id"), F.lit(0.0).alias("logit")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
