"""Texts beyond the lengths at which operators take them in stretches, and characters of all planes, with values compared."""

import random

import plain
import pytest
from pyspark.sql import functions as F
from test_brute_force import plain_fingerprint

from inkflow.llm import language, quality, simhash, urls


def long_text(words, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randrange(2, 9))) for _ in range(3000)]
    return " ".join(rng.choices(vocabulary, k=words))


def test_fingerprint_of_many_shingles():
    t = long_text(150_000, 1)
    assert simhash.fingerprint(t, 3) == plain_fingerprint(t)


def test_language_of_a_long_text(spark):
    texts = [long_text(260_000, 2), "kurz und gut", "short and plain"]
    assert len(texts[0]) > language.CHARS
    learn = [("plain words of one language and more", "en"), ("kurze Worte einer Sprache und mehr", "de"), (long_text(300, 3), "xx")]
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(10 + i, t, lang) for i, (t, lang) in enumerate(learn)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d, F.col("doc_id") >= 10).collect()}
    for i, (lang, score) in enumerate(plain.bayes(learn, texts)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-3)


def test_perplexity_in_stretches_and_planes(spark):
    """Characters beyond 16 bits are told apart, wherever a stretch of a long text begins."""
    texts = ["\U0001f970\U0001f971 one \U0001f970\U0001f972 two", "\U0001f970 alone", "no such character", "x\U00010428yz" * 30]
    model = plain.KneserNey(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r["doc"]["doc_id"]: r["log_p"] for r in quality.scored(d, *quality.kneser_ney(quality.counts(d))).collect()}
    for i, t in enumerate(texts):
        assert scores[i] == pytest.approx(model.log_p(t), rel=1e-4, abs=1e-3)
    rng = random.Random(9)
    t = "".join(rng.choices("ab \U0001f970\U00010428é", k=500))
    whole = quality.grams(t)
    for chars in (1, 2, 3, 7, 100):
        for k in range(len(whole)):
            parts = [g[k][skip:] for g, skip in quality.pieces(t, chars)]
            assert [x for p in parts for x in p.tolist()] == whole[k].tolist()


def test_borders_of_shards(spark):
    """Shards of about equal size from bounded counts, with fingerprints that a third of which begin alike."""
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(40_000)} | {rng.getrandbits(48) for _ in range(20_000)}
    d = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "fp long")
    rows = simhash.tables(d, 2)
    ends = simhash.borders(rows, 2, len(codes) / 100)
    assert sorted(ends) == [0, 1, 2]
    for r in rows.groupBy("place").agg(F.array_sort(F.collect_list("lead")).alias("leads")).collect():
        e, sizes = ends[r["place"]], {}
        assert list(e) == sorted(set(e)) and 30 < len(e) < 101
        for x in r["leads"]:
            s = int((e < x).sum())
            sizes[s] = sizes.get(s, 0) + 1
        usual = sorted(sizes.values())[: -1 if r["place"] == 0 else None]  # one prefix is a third of the first table
        assert max(usual) < 2.5 * len(codes) / 100


def test_deep_paths(spark):
    """Every segment of a path is a node, however deep; a path that no other follows is finished at once."""
    deep = "/".join(f"s{chr(97 + i % 26)}" for i in range(3000))
    given = [f"http://h.io/{deep}", f"http://h.io/{deep[:30]}/x", "http://h.io/a/b/c/d/e/f/spam/1", "http://h.io/a/b/c/d/e/f/news/1"] * 2
    labels = spark.createDataFrame([(i, int("spam" in u)) for i, u in enumerate(given)] + [(100 + i, i % 2) for i in range(80)], "page_id long, bad int")
    pages = list(enumerate(given)) + [(100 + i, f"http://h.io/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/{i}") for i in range(80)]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels=labels)
    assert got.where("verdict <> if(path like '%/f/spam/%', 'block', 'allow')").isEmpty()
    t = got.where("page_id = 0").first()["template"].split("/")
    assert len(t) == 3001 and t[40:] == f"/{deep}".split("/")[40:]
