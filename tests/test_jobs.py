"""Whole jobs, their resumption, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from inkflow.functions import encode, vocab
from inkflow.operators import decode, sampling
from inkflow.functions.text import clean
from inkflow.plans import jobs, sequence
from inkflow.sources import readers, shards
from inkflow.streaming import windows as streaming

CODES = [("日", "a"), ("明", "ab"), ("林", "dd")]


def docs(spark, n=40):
    return spark.createDataFrame([(i, f"text {i} \\12 é" * (i % 7) + "明日", "ab"[i % 2]) for i in range(n)], "doc_id long, text string, source string")


def test_shards_go_on_where_they_stopped(spark, tmp_path):
    d, whole, parts = docs(spark), str(tmp_path / "whole"), str(tmp_path / "parts")
    all_ids = [i for r in jobs.placed(d, CODES).orderBy("start").collect() for i in r["ids"]]
    jobs.build_shards(d, whole, 300, block=16, codes=CODES)
    first = jobs.build_shards(d, parts, 300, block=16, most=700, codes=CODES)
    assert first["rows_written"] == 700 and [s["rows"] for s in first["shards"]] == [300, 300, 100]
    assert jobs.build_shards(d, parts, 300, block=16, most=700, codes=CODES) == first
    last = jobs.build_shards(d, parts, 300, block=16, codes=CODES)
    assert last["rows_written"] == len(all_ids)
    for path in (whole, parts):
        t = spark.read.parquet(f"{path}/tokens").orderBy("shard_id", "start").collect()
        assert [i for r in t for i in r["ids"]] == all_ids
    with pytest.raises(ValueError):
        jobs.build_shards(d, parts, 300, block=16, source="a", codes=CODES)
    train, held = jobs.training_split(spark, whole, 1, 16, 16)
    assert train.count() + held.count() == sum((s["rows"] - 17) // 16 + 1 for s in shards.read_json(spark, f"{whole}/manifest.json")["shards"])


def test_shards_survive_a_crash(spark, tmp_path):
    """Shards that no manifest names are written anew, whatever an interrupted run left there; no reader ever misses the manifest."""
    d, path = docs(spark), str(tmp_path / "s")
    jobs.build_shards(d, path, 300, block=16, most=600, codes=CODES)
    held = shards.read_json(spark, f"{path}/manifest.json")
    jobs.build_shards(d, path, 300, block=16, codes=CODES)
    whole = shards.read_json(spark, f"{path}/manifest.json")
    shards.write_json(spark, f"{path}/manifest.json", held)  # the second run ended before its manifest
    again = jobs.build_shards(d, path, 300, block=16, most=900, codes=CODES)
    assert [s["rows"] for s in again["shards"]] == [300, 300, 300] and again["rows_written"] == 900
    assert spark.read.parquet(f"{path}/tokens").select("shard_id").distinct().count() == 3
    last = jobs.build_shards(d, path, 300, block=16, codes=CODES)
    assert last["shards"] == whole["shards"] and not [p for p in (tmp_path / "s").iterdir() if p.suffix == ".tmp"]
    ids = [i for r in spark.read.parquet(f"{path}/tokens").orderBy("shard_id", "start").collect() for i in r["ids"]]
    assert ids == [i for r in jobs.placed(d, CODES).orderBy("start").collect() for i in r["ids"]]


def test_a_cache_of_another_length_is_none(spark, tmp_path):
    path, meta = str(tmp_path / "c"), {"block": 16, "files": ("a", "b")}
    shards.write_cache(jobs.placed(docs(spark)).select("start", "ids"), path, meta)
    assert shards.read_cache(spark, path, meta) is not None and shards.read_cache(spark, path, {"block": 8}) is None
    held = shards.read_json(spark, f"{path}/meta.json")
    shards.write_json(spark, f"{path}/meta.json", held | {"rows": held["rows"] + 1})
    assert shards.read_cache(spark, path, meta) is None


@pytest.mark.parametrize("key", ["id", "xxhash64(id)", "id * 1000003 - 7", "if(id % 2 = 0, id, id + 9000000000000000000)", "cast(1 as long)"])
def test_prefix_sums_of_any_keys(spark, key):
    d = spark.range(3000).select(F.expr(key).alias("k"), (F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("g"))
    got = sequence.prefix_sum(d, "k", F.col("v"), "s", by=("g",)).collect()
    rows, want = sorted((r["g"], r["k"]) for r in got), {}
    for g in range(3):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"], r["s"])):
            assert r["s"] == total
            total += r["v"]
        want[g] = total
    assert len(rows) == 3000 and sum(want.values()) == sum(i % 7 for i in range(3000))


def test_symbols_that_no_character_has(spark):
    d = spark.createDataFrame([(["cj_z", "cj_z", "[PAD]", "[PAD]", "[PAD]"],)], "symbols array<string>")
    codes = spark.createDataFrame([(0, "日", "a")], "ord int, char string, code string")
    with pytest.raises(Exception, match="no character has the code zz"):
        decode.candidates_of_code(d, codes).collect()
    with pytest.raises(Exception, match="no token"):
        d.select(decode.rows_of_symbols(F.array(*[F.lit("nothing")] * 5))).collect()


def test_vocabulary_from_sources(spark):
    d = spark.createDataFrame([(1, "明日明日林木", "a"), (2, "林木１２", "b"), (3, "明日", "c")], "doc_id long, text string, source string")
    got = jobs.build_vocabulary(d, {"a": 1.0, "b": 1.0}, {"明日": 5, "林木": 5}).collect()
    assert [(r["word"], r["n"]) for r in got] == [("明日", 2), ("林木", 2)]
    with pytest.raises(ValueError):
        jobs.build_vocabulary(d, {"z": 1.0}, {})


def test_stream_equals_batch(spark, tmp_path):
    d = docs(spark, 60).select("doc_id", F.regexp_replace("text", "[明日]", "x").alias("text"))
    for k in range(3):  # three micro-batches in the order of their files
        d.where(F.floor(F.col("doc_id") / 20) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streaming.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 1)
    streaming.stream_to_parquet(streaming.stream_windows(s, 32, 16), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).select("window_id", "x", "target")
    want = sequence.windows(jobs.placed(d), 32, 16)
    assert got.count() == want.count() > 50 and got.exceptAll(want).isEmpty()


def test_stream_to_shards_is_idempotent(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("pos"), F.lit(7).alias("output_id")).write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second time as if nothing had been noted
        s = streaming.read_stream(spark, str(tmp_path / "in"), "pos long, output_id int")
        streaming.stream_to_shards(s, str(tmp_path / "out"), str(tmp_path / f"check{k}"), 300)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard_id").count().orderBy("shard_id").collect()[-1]["count"] == 100


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "codes.json").write_text(json.dumps({"日": "a", "曰": "a", "明": "ab"}, ensure_ascii=False))
    (tmp_path / "words.json").write_text(json.dumps(["明日", "明日"], ensure_ascii=False))
    codes = readers.read_codes(spark, str(tmp_path / "codes.json"))
    assert [r["code"] for r in vocab.code_index(codes).orderBy("code_index").collect()] == ["a", "ab"]
    with pytest.raises(ValueError):
        readers.read_words(spark, str(tmp_path / "words.json"))
    shards.write_vocabulary(spark, str(tmp_path / "v.json"), ["明日"])
    assert shards.read_vocabulary(spark, str(tmp_path / "v.json")) == ["明日"]


def test_strict_ids(spark):
    d = spark.createDataFrame([("明a日",)], "t string")
    assert d.select(encode.strict_ids(F.col("t"), CODES)).first()[0] == [358, 69, 357]
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([("是",)], "t string").select(encode.strict_ids(F.col("t"), CODES)).collect()


def test_sampled_loss(spark):
    logits = spark.createDataFrame([(s, i, float(i * s % 5)) for s in range(3) for i in range(6)], "step int, output_id int, logit double")
    targets = spark.createDataFrame([(0, 1), (1, 2), (2, -100)], "step int, target int")
    everything = spark.createDataFrame([(i,) for i in range(6)], "output_id int")
    whole = sampling.cross_entropy(logits, targets).first()[0]
    assert sampling.sampled_cross_entropy(logits, targets, everything).first()[0] == pytest.approx(whole)
    assert sampling.sampled_cross_entropy(logits, targets, everything.limit(1)).first()[0] < whole
    assert sampling.cross_entropy(logits, targets.where("target < 0")).first()[0] is None


@pytest.mark.parametrize("key", ["id", "if(id = 99999, 9000000000000000000, id)", "xxhash64(id)", "if(id % 3 = 0, null, id)"])
def test_ranges_follow_the_data(spark, key):
    """No range holds more than twice the mean, one key far from all others or not."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = [r["count"] for r in sequence.key_ranges(spark.range(100_000).select(F.expr(key).alias("k")), ("k",), F.lit(1)).groupBy("_part").count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(n) == 32 and max(n) <= 2 * sum(n) / len(n)


def test_prefix_sums_of_ties(spark):
    """Rows of one key, alike or not, have places of their own; nulls come first."""
    rows = [(None, f"t{i % 50}", i % 4) for i in range(300)] + [(5, "same", 2)] * 7 + [(5, "other", 3), (9, None, 1), (-1, "x", 4)]
    d = spark.createDataFrame(rows, "k long, t string, v int").withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    got = sorted(((r["s"], r["v"], r["k"]) for r in sequence.prefix_sum(d, "k", F.col("v") + 1, "s").collect()), key=lambda x: x[0])
    at = 0
    for s, v, _ in got:
        assert s == at
        at += v + 1
    keys = [k for _, _, k in got]
    assert keys == [None] * 300 + [-1] + [5] * 8 + [9] and len(got) == len(rows)


@pytest.mark.parametrize(("block", "stride", "shards"), [(32, 16, 1), (64, 64, 3), (7, 5, 2)])
def test_windows_of_a_stopped_stream(spark, tmp_path, block, stride, shards):
    """Each arrival is a run of its own: the windows are those of one sequence for each shard, and fast-forward leaves out whole steps."""
    d = docs(spark, 60).select("doc_id", F.regexp_replace("text", "[明日]", "x").alias("text"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 0), (1, 1), (2, 40), (41, 59)):
        d.where(F.col("doc_id").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        streaming.stream_to_windows(streaming.read_stream(spark, source, "doc_id long, text string", 1), out, str(tmp_path / "check"), block, stride, shards)
    placed = sequence.prefix_sum(d.select(F.pmod("doc_id", F.lit(shards)).cast("int").alias("shard"), "doc_id", encode.framed(encode.encoder()(F.col("doc_id"), clean(F.col("text")))).alias("ids")), "doc_id", F.size("ids"), "start", by=("shard",))
    want = {(r["shard"], r["window_id"]): (r["x"], r["target"]) for r in sequence.windows(placed, block, stride, by=("shard",)).collect()}
    got = {(r["shard"], r["window_id"]): (r["x"], r["target"]) for r in streaming.read_windows(spark, out).collect()}
    assert got == want and len(got) > 20
    rest = {(r["shard"], r["window_id"]) for r in streaming.read_windows(spark, out, step=3, per_step=4).collect()}
    assert rest == {(s, w) for s, w in want if w * shards + s >= 12}


def test_windows_of_a_batch_that_is_repeated(spark, tmp_path):
    d = docs(spark, 30).select("doc_id", F.regexp_replace("text", "[明日]", "x").alias("text"))
    out = str(tmp_path / "out")
    for batch_id, (low, high) in enumerate(((0, 9), (10, 11), (12, 29))):
        for _ in range(2):  # the second time as if its commit had been lost
            streaming.windows_of_batch(d.where(F.col("doc_id").between(low, high)), batch_id, out, 32, 16)
    got = streaming.read_windows(spark, out).select("window_id", "x", "target")
    want = sequence.windows(jobs.placed(d), 32, 16)
    assert got.count() == want.count() > 20 and got.exceptAll(want).isEmpty()


def test_registered_windows_of_a_stream_hold_no_shard_in_a_task(spark, sf_dir, monkeypatch):
    """The registered query does not go by the keyed state, which sorts what a micro-batch brings to a shard in one task."""
    from inkflow.plans import queries

    monkeypatch.setattr(queries.streaming, "stream_windows", None)
    w = queries.stream_windows(spark, sf_dir)
    assert w.columns == ["shard", "window_id", "x_md5", "target_md5"] and w.select("shard").distinct().count() == queries.STREAM_SHARDS
