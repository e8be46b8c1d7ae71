"""Slices of Arrow batches, and the operators that work on whole texts and lists in place of rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkflow.functions import batches, encode, vocab
from inkflow.operators import decode, model, sampling, suffixes, wordfreq


def test_slices_follow_bytes():
    a = pa.array(["x" * 400, None, "y" * 900, "z", "", "w" * 3000])
    parts = [p[0] for p in batches.slices((a,), 1000)]
    assert pa.concat_arrays(parts).equals(a) and len(parts) > 2
    assert all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= 2000 for p in parts)
    assert [len(p[0]) for p in batches.slices((a[:0],))] == [0]


def test_long_texts_are_encoded_without_paths(spark):
    """A text of 200,000 characters beyond ASCII, and a code for a character that is a token already."""
    d = spark.createDataFrame([(1, "木é" * 100_000), (2, "a木"), (3, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in d.select("doc_id", encode.encoder([("木", "ab")])(F.col("doc_id"), F.col("text"))).collect()}
    assert got[1] == [357, 101 + 0xC3, 101 + 0xA9] * 100_000 and got[2] == [ord("a") - 28, 357] and got[3] == []


def test_memory_beside_the_ids_does_not_grow_with_a_text(monkeypatch):
    """Pieces end between characters of any width, and give the ids that the whole text gives."""
    table = encode.single_ids([("木", "ab")])
    text = "木é a\n🥰" * 500_000
    tracemalloc.start()
    got = encode.ids_of(text, table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * got.nbytes
    assert got.tolist() == [357, 101 + 0xC3, 101 + 0xA9, 4, ord("a") - 28, 99, *(101 + b for b in "🥰".encode())] * 500_000
    for n in (1, 2, 5, 99):
        monkeypatch.setattr(encode, "PIECE", n)
        assert [encode.ids_of(text[:k], table).tolist() for k in (0, 1, 5, 6, 50)] == [got[:k].tolist() for k in (0, 1, 6, 10, 83)]


def test_words_are_counted_before_they_are_written(spark):
    d = spark.createDataFrame([(0, 2, ["ab", "木b", "c"]), (0, 1, ["x", "ab"])], "source_ord int, doc_id long, words array<string>")
    got = wordfreq.word_counts(d, lambda w: F.translate(w, "abcx", "木林明月"))
    assert {r["word"]: (r["n"], tuple(r["first"])) for r in got.collect()} == {"木林": (3, (0, 1, 1))}


def test_merged_tokens(spark):
    lists = [[341, 260, 266, 277, 37, 341], [], None, [296, 270, 99], [352], [99, 352]]
    d = spark.createDataFrame(list(enumerate(lists)), "i int, ids array<int>").coalesce(1)
    got = [r[1] for r in d.select("i", decode.merged_tokens(F.col("ids"), vocab.tokens()[26:])).orderBy("i").collect()]
    assert got == [["🥰", "A", "�"], [], None, ["é", "\n"], ["�"], ["\n", "�"]]


def test_best_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_WORDS", 2)
    words = spark.createDataFrame([("a", [5]), ("ba", [9]), ("cba", [1]), ("b", [3]), ("abab", [7])], "word string, score array<long>")
    texts = spark.createDataFrame([(1, "cbaxab"), (2, ""), (3, None), (4, "xx"), (4, "ab")], "id long, text string")
    got = {r["id"]: r["best"] for r in suffixes.best_scores(texts, ("id",), words, 0, 2).collect()}
    assert got == {1: [None, [3], [9], None, [5], [3]], 2: [], 4: [[5], [3]]}


def test_next_ids_are_a_greedy_pick(spark):
    shape = model.Shape(width=16, layers=2, heads=4, shared=2, hidden=24, block=64)
    w, rng = model.initial(shape, len(vocab.tokens())), np.random.default_rng(1)
    outs = vocab.output_vocabulary(spark)
    seqs = [(i, rng.integers(0, 350, 1 + i % 7 * 9).tolist()) for i in range(60)] + [(60, [])]
    d = spark.createDataFrame(seqs, "seq long, ids array<int>").repartition(2)
    want = sampling.pick(model.next_logits(d, outs, w, shape), "greedy")
    assert sorted(map(tuple, model.next_ids(d, outs, w, shape).collect())) == sorted(map(tuple, want.collect()))


def test_shards_are_listed_without_ids(spark, sf_dir):
    from inkflow.plans import queries, sequence

    plan = queries.shard_list(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
    d = spark.createDataFrame([(0, [1] * 5), (5, [1] * 12), (17, [])], "start long, ids array<int>")
    assert sorted((r["shard_id"], r["rows"]) for r in sequence.manifest(d, 4, 2, 2).collect()) == [(0, 4), (1, 4), (2, 4), (3, 4), (4, 1)]


def test_words_are_counted_in_their_lists(spark, monkeypatch):
    """Counts and first places as from a row for each word, whatever the slices; lists that are null, words that are blank, sources that are null."""
    monkeypatch.setattr(wordfreq, "SLICE_BYTES", 100)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)) if i % 9 else None, 50 - i, None if i == 3 else [f"木{x} " if x % 2 else f" 明日{'林' * x}" for x in rng.integers(0, 6, i % 13)]) for i in range(50)]
    d = spark.createDataFrame(rows, "source_ord int, doc_id long, words array<string>").repartition(3)
    want = {}
    for source, doc, words in rows:
        for place, w in enumerate(words or ()):
            if not any(c.isdigit() for c in w):
                n, first = want.get(w.strip(), (0, (9, 0, 0)))
                want[w.strip()] = (n + 1, min(first, (-1 if source is None else source, doc, place)))
    counts = wordfreq.word_counts(d)
    got = {r["word"]: (r["n"], (-1 if r["first"][0] is None else r["first"][0], *r["first"][1:])) for r in counts.collect()}
    assert {w: got[w] for w in want} == want and len(want) == 3
    assert "MapInArrow" in counts._jdf.queryExecution().optimizedPlan().toString()


def test_characters_are_found_without_cutting_words(spark, sf_dir, tmp_path):
    from inkflow.plans import han

    rows = [(1, "abz 9"), (2, None), (3, han.HAN[3] + "Q"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = han.shapes(spark, str(tmp_path))
    assert sorted((r["ord"], r["char"]) for r in found.collect()) == list(enumerate(han.HAN[i] for i in (0, 1, 3, 25)))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_of_whole_texts_are_spelled_at_once(spark):
    lists = [["a", "", "no", "\n", "é", "no"], None, [], [" "], ["", "[PAD]", "cj_b"]]
    d = spark.createDataFrame(list(enumerate(lists)), "i int, s array<string>").coalesce(1)
    got = [r[1] for r in d.select("i", decode.first_ids_of_symbols(F.col("s"))).orderBy("i").collect()]
    each = d.select("i", F.posexplode("s").alias("p", "w")).select("i", "p", decode.rows_of_symbols(F.when(F.col("w") == "", F.array().cast("array<string>")).otherwise(F.array("w"))).alias("r"))
    want = {(r["i"], r["p"]): ";".join(str(x[0]) for x in r["r"]) for r in each.collect()}
    assert got == [None if s is None else [want[i, p] for p in range(len(s))] for i, s in enumerate(lists)]


def test_symbol_rows_move_no_word(spark, sf_dir):
    from inkflow.plans import queries

    plan = queries.symbol_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
