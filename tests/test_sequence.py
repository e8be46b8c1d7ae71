"""Windows, shards, mixes and codes beyond what the tables show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.functions import encode, vocab
from inkflow.operators import decode, model, numeric, sampling
from inkflow.plans import sequence
from inkflow.sources import mix, readers, shards


def docs(spark, sizes):
    rows, at = [], 0
    for n in sizes:
        rows.append((at, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "start long, ids array<int>")


@pytest.mark.parametrize(("n", "want"), [(0, 0), (256, 0), (257, 1), (512, 1), (513, 2)])
def test_window_counts(spark, n, want):
    got = sequence.windows(docs(spark, [n // 3, n - n // 3])).collect()
    assert len(got) == want == spark.range(1).select(sequence.window_count(F.lit(n))).first()[0]
    for r in got:
        assert r["x"] == list(range(r["window_id"] * 256, r["window_id"] * 256 + 256)) and r["target"] == [i + 1 for i in r["x"]]


@pytest.mark.parametrize(("block", "stride"), [(4, 4), (5, 2), (8, 3)])
def test_windows_cross_documents(spark, block, stride):
    sizes = [3, 0, 1, 17, 2, 9]
    n = sum(sizes)
    got = {r["window_id"]: r["x"] for r in sequence.windows(docs(spark, sizes), block, stride).collect()}
    assert got == {k: list(range(k * stride, k * stride + block)) for k in range(max(0, (n - block - 1) // stride + 1))}
    with pytest.raises(ValueError):
        sequence.windows(docs(spark, [3]), 2, 3)


def test_prefix_sum_by_key(spark):
    d = spark.range(200_000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = sequence.prefix_sum(d, "id", F.lit(1), "turn", by=("k",))
    assert got.where("turn <> id div 3").isEmpty() and got.count() == 200_000


def test_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    m = shards.write_shards(docs(spark, [700, 900, 100]), path, 600, source={"a": (1, 2)}, most=1650)
    assert [x["rows"] for x in m["shards"]] == [600, 600, 450] and m["rows_written"] == 1650
    got = shards.read_shards(spark, path, first=1).collect()
    assert sorted((r["shard_id"], r["window_id"], r["x"][0]) for r in got) == [(1, 0, 600), (1, 1, 856), (2, 0, 1200)]
    assert shards.resume(spark, path, 600, source={"a": [1, 2]}) == m
    for wrong in ({"per_shard": 601}, {"per_shard": 600, "block": 128}, {"per_shard": 600, "source": {"a": 3}}):
        with pytest.raises(ValueError):
            shards.resume(spark, path, **{"source": {"a": [1, 2]}} | wrong)
    with pytest.raises(ValueError):
        shards.read_shards(spark, path, first=9)
    assert shards.rows_per_shard() == 22_369_621


def test_cache(spark, tmp_path):
    path = str(tmp_path / "c")
    assert shards.read_cache(spark, path, {}) is None
    shards.write_cache(docs(spark, [3]), path, {"v": (1,)})
    assert shards.read_cache(spark, path, {"v": [1]}).count() == 1
    assert shards.read_cache(spark, path, {"v": [2]}) is None


def test_interleave_shares(spark):
    d = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    m = mix.interleave(d, {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    n = {r[0]: r[1] for r in m}
    assert n["a"] == 3000 and abs(n["b"] - 3000) < 200
    again = mix.interleave(d, {"a": 1.0, "b": 1.0}, stop="all_exhausted")
    assert again.where("source = 'b'").select("doc_id").distinct().count() == 6000
    with pytest.raises(ValueError):
        mix.mix_weights(spark, {"a": 0.0})


def test_source_filters(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id int, source string")
    ids = lambda x: sorted(r[0] for r in x.collect())
    assert ids(readers.by_source(d, "a")) == [1] and ids(readers.by_source(d, "a", "exclude")) == [2, 3] and ids(readers.by_source(d, None)) == [1, 2, 3]
    for bad in (lambda: readers.by_source(d, "a", "only"), lambda: readers.filtered_or_error(d, "z")):
        with pytest.raises(ValueError):
            bad()


def test_read_documents(spark, tmp_path):
    spark.range(3).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source").write.json(str(tmp_path / "j"))
    spark.range(5).selectExpr("id AS doc_id", "'t' AS text").write.parquet(str(tmp_path / "p/train"))
    assert readers.read_documents(spark, json_path=str(tmp_path / "j"), path="nowhere").count() == 3
    assert readers.read_documents(spark, path=str(tmp_path / "p"), split="train").count() == 5
    assert readers.read_documents(spark, path=str(tmp_path / "p/train"), streaming=True).isStreaming
    two = [{"name": n, "path": str(tmp_path / "p"), "split": "train"} for n in "ab"]
    assert 5 <= readers.read_documents(spark, mix=two).count() <= 10


def test_rows_and_keys(spark):
    outs = vocab.output_vocabulary(spark, spark.createDataFrame([(0, "日", "a"), (1, "明", "ab")], "ord int, char string, code string"))
    keys = outs.select(vocab.pack(F.col("row")).alias("k"))
    assert keys.distinct().count() == keys.count() == 359
    rows = spark.createDataFrame([([i, 26, 26, 26, 26],) for i in (30, 255, 113)], "row array<int>")
    assert sorted(r[0] for r in vocab.to_output_ids(rows, outs).select("output_id").collect()) == [4, 87, 229]
    with pytest.raises(Exception, match="row without an output"):
        vocab.to_output_ids(spark.createDataFrame([([25, 25, 25, 25, 25],)], "row array<int>"), outs).collect()
    with pytest.raises(Exception, match="more than five"):
        spark.createDataFrame([("abcdef",)], "c string").select(vocab.code_row(F.col("c"))).collect()
    with pytest.raises(ValueError):
        vocab.tokens(["[PAD]"])


def test_bytes_round_trip():
    table = encode.single_ids()
    for text in ("", "plain\n\t~", "é🥰日\x00\x7f", "\x01" * 3):
        ids = encode.ids_of(text, table)
        assert len(ids) == len(text.encode())
        raw = bytes(i - 101 if i >= 101 else 10 if i == 99 else 9 if i == 100 else i + 28 for i in ids.tolist())
        assert raw.decode() == text


def test_beam_prefers_words():
    lexicon = decode.Lexicon({"日": 100, "曰": 5, "明": 50, "明日": 30})
    assert decode.best_reading(["明", ["曰", "日"]], lexicon) == ["明", "日"]
    assert decode.best_reading([["曰", "日"]], lexicon) == ["日"]
    assert decode.best_reading([[], ["xx"], "a"], lexicon) == ["", "xx", "a"]


def test_rotation_keeps_lengths_and_agrees(spark):
    v = np.random.default_rng(0).standard_normal(8).astype(np.float32)
    d = spark.createDataFrame([(v.tolist(), 3)], "v array<float>, pos int")
    got = np.array(d.select(numeric.rotary(F.col("v"), F.col("pos"))).first()[0])
    x = np.zeros((4, 1, 8))
    x[3, 0] = v
    assert np.allclose(got, model.rotated(x, 1e5)[3, 0], atol=1e-6) and np.isclose((got**2).sum(), (v**2).sum(), atol=1e-5)
    norm = np.array(d.select(numeric.rms_norm(F.col("v"))).first()[0])
    assert np.allclose(norm, model.rms(v, 1.0), atol=1e-6)


def test_model_is_causal_and_bounded():
    shape = model.Shape(width=16, layers=2, heads=4, shared=2, hidden=24, block=8)
    w = model.initial(shape, 383)
    rows = np.array([[30 + i, 26, 26, 26, 26] for i in range(6)] + [[0, 1, 26, 26, 26]])
    whole = model.forward(rows, w, shape)
    assert np.allclose(whole[:4], model.forward(rows[:4], w, shape), atol=1e-6)
    with pytest.raises(ValueError):
        model.forward(np.repeat(rows, 2, axis=0), w, shape)
    assert model.slot_loss(whole, np.full((7, 5), -100), w) == 0.0
    assert model.slot_loss(whole, np.array([[-100] * 5] * 6 + [[0, 1, 26, 26, 26]]), w) == pytest.approx(0.15 * np.log(27), rel=0.05)


def test_ties_stay_in_top_k(spark):
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate([3.0, 2.0, 2.0, 1.0])], "step int, output_id int, logit double")
    kept = sampling.top_k(d, 2).where("logit > double('-Infinity')").count()
    assert kept == 3 and sampling.top_k(d, 0).count() == 4
    with pytest.raises(ValueError):
        sampling.pick(d, "best")


def test_splits():
    assert [sequence.validation_windows(n) for n in (128, 129, 100_000, 10_000_000)] == [0, 128, 200, 1024]
    assert [sequence.validation_shards(n) for n in (1, 3, 9)] == [0, 2, 4]


def test_ids_are_made_once_below_a_filter(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    ids = d.select("doc_id", encode.framed(encode.encoder()(F.col("doc_id"), F.col("text"))).alias("ids")).where(F.size("ids") > 2)
    assert [r["ids"] for r in ids.collect()] == [[2, 69, 70, 3]]
    assert ids._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_windows_inside_a_document_are_not_grouped(spark):
    """Of 10,000 windows only those that cross documents are put together: the rows that go into groups are their parts."""
    d = docs(spark, [0, 2563, 2000, 5, 35_433])
    w = sequence.windows(d, 4, 4)
    assert {r["window_id"]: r["x"] for r in w.collect()} == {k: [4 * k + i for i in range(4)] for k in range(10_000)}
    plan = w._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union" and "Aggregate" not in plan.children().apply(0).toString()
