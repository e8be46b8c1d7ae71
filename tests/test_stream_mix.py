"""The mix of a stream against the mix of all its rows, over arrivals of any size, restarts and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from inkflow.sources import mix, readers
from inkflow.streaming import mix as streaming
from inkflow.streaming import state, windows

WEIGHTS = {"a": 2.0, "b": 1.0, "none": 0.0}
SCHEMA = "doc_id long, source string, text string"


def docs(spark, n, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice(["a", "a", "b", "other", None]), f"t{i}") for i in range(n)], SCHEMA)


def arrive(d, low, high, path):
    d.where(F.col("doc_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)


def ordered(d):
    return [tuple(r) for r in d.select("k", "doc_id", "source", "text").orderBy("k").collect()]


@pytest.mark.parametrize("borders", [[0, 900], [0, 1, 2, 640, 900]])
def test_equals_the_batch(spark, tmp_path, borders):
    """Each arrival is a restart; after every one the mix is that of the rows until then."""
    d, source, out = docs(spark, 900), str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in zip(borders, borders[1:]):
        arrive(d, low, high, source)
        streaming.interleave_to_parquet(windows.read_stream(spark, source, SCHEMA, 1), WEIGHTS, out, str(tmp_path / "check"))
        got = ordered(streaming.read_mixed(spark, out))
        assert got == ordered(mix.interleave(d.where(F.col("doc_id") < high), WEIGHTS))
    assert len(got) > 500 and [k for k, *_ in got] == list(range(len(got)))


def test_a_batch_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    """The first time a batch ends before its state is noted, the second time after it: both run again from the state before."""
    d, source, out, check = docs(spark, 400), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    noted = state.write_state
    for at, note_first in ((150, False), (300, True), (400, None)):
        arrive(d, {150: 0, 300: 150, 400: 300}[at], at, source)

        def stops(spark, path, batch_id, value):
            if note_first:
                noted(spark, path, batch_id, value)
            raise OSError("gone")

        run = lambda: streaming.interleave_to_parquet(windows.read_stream(spark, source, SCHEMA, 1), WEIGHTS, out, check)
        if note_first is not None:
            monkeypatch.setattr(streaming, "write_state", stops)
            with pytest.raises(Exception, match="gone"):
                run()
            monkeypatch.setattr(streaming, "write_state", noted)
        run()
        assert ordered(streaming.read_mixed(spark, out)) == ordered(mix.interleave(d.where(F.col("doc_id") < at), WEIGHTS))


def test_sources_of_a_streaming_mix(spark, tmp_path):
    d = docs(spark, 200)
    for n in "ab":
        d.where(F.col("source") == n).coalesce(1).write.parquet(str(tmp_path / n))
    parts = [{"name": n, "weight": w, "path": str(tmp_path / n)} for n, w in (("a", 2.0), ("b", 1.0))]
    s = readers.read_documents(spark, mix=parts, streaming=True, schema=SCHEMA)
    assert s.isStreaming and "mix_name" in s.columns
    streaming.interleave_to_parquet(s, {"a": 2.0, "b": 1.0}, str(tmp_path / "out"), str(tmp_path / "check"), source="mix_name")
    assert ordered(streaming.read_mixed(spark, str(tmp_path / "out"))) == ordered(readers.read_documents(spark, mix=parts))
    with pytest.raises(ValueError):
        readers.read_documents(spark, mix=[{"name": "a", "weight": 0, "path": str(tmp_path / "a")}], streaming=True)


def test_nothing_to_mix(spark, tmp_path):
    d = docs(spark, 30).withColumn("source", F.lit("a"))  # the other source never comes
    arrive(d, 0, 30, str(tmp_path / "in"))
    streaming.interleave_to_parquet(windows.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1), {"a": 1.0, "b": 1.0}, str(tmp_path / "out"), str(tmp_path / "check"))
    assert ordered(streaming.read_mixed(spark, str(tmp_path / "out"))) == ordered(mix.interleave(d, {"a": 1.0, "b": 1.0}))
    with pytest.raises(ValueError):
        streaming.read_mixed(spark, str(tmp_path / "nothing"))
