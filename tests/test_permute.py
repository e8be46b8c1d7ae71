"""The permutation at odd sizes, and batches of windows by it."""

import pytest
from pyspark.sql import functions as F

from inkflow.operators import numeric
from inkflow.sources import permute


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 97, 128, 1001, 65_537])
def test_bijection(spark, n):
    d = spark.range(n).select("id", permute.number_at(F.col("id"), n, 5).alias("number")).withColumn("back", permute.place_of(F.col("number"), n, 5))
    rows = d.collect()
    assert sorted(r["number"] for r in rows) == list(range(n)) and all(r["id"] == r["back"] for r in rows)
    if n > 1000:  # neighbours do not stay together, and another seed gives another order
        assert sum(abs(a["number"] - b["number"]) < 10 for a, b in zip(rows, rows[1:])) < n / 20
        assert spark.range(n).where(permute.number_at(F.col("id"), n, 5) == permute.number_at(F.col("id"), n, 6)).count() < n / 50


def test_rectangle_is_close():
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39):
        a, b = permute.rectangle(n)
        assert 0 <= a * b - n < 2000


def test_batches(spark):
    w = spark.range(1001).select(F.col("id").alias("window_id"))
    got = permute.shuffled_minibatches(w, 1001, 64, seed=3, epoch=2)
    sizes = {r["batch_id"]: r["count"] for r in got.groupBy("batch_id").count().collect()}
    assert sizes == {k: 64 for k in range(15)} | {15: 41}
    for k in (0, 7, 15, 16):
        one = {(r["row"], r["window_id"]) for r in permute.batch_windows(spark, k, 1001, 64, seed=3, epoch=2).collect()}
        assert one == {(r["row"], r["window_id"]) for r in got.where(F.col("batch_id") == k).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_logits_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, -0.5]) for i in range(7)] + [(9, None)], "k int, v array<double>")
    o = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(11)] + [(99, None)], "output_id int, row array<double>")
    want = {(i, j): i + j - 1.0 for i in range(7) for j in range(11)}
    for block in (4, 100):
        assert {(r["k"], r["output_id"]): r["logit"] for r in numeric.logits(v, o, "k", "v", block).collect()} == want
    assert numeric.logits(v, o.limit(0), "k", "v").count() == 0
