"""Words that end at a place, by the index, against a look at every word; and decoding against a beam that keeps everything."""

import random

from pyspark.sql import functions as F

from inkflow.functions import encode
from inkflow.operators import decode, suffixes, wordfreq
from inkflow.plans import han


def plain_scores(freq, context, char):
    """(length, frequency, -rank) of the best ranked word, and the greatest frequency of any end of the context with the character."""
    cjk = [(w, f) for w, f in freq.items() if f > 0 and 2 <= len(w) <= 4]
    ranked = sorted(cjk, key=lambda x: (-x[1], -len(x[0]), x[0]))[:20_000]
    word = max(((len(w), f, -i) for i, (w, f) in enumerate(ranked) if (context + char).endswith(w)), default=None)
    ends = [freq[w] for i in range(len(context) + 1) if (w := context[i:] + char) in freq]
    return word, max(ends, default=None)


def test_index_against_all_words(spark):
    rng = random.Random(8)
    chars = "木末本札术"
    freq = {"".join(rng.choices(chars, k=rng.randrange(1, 7))): rng.randrange(4) for _ in range(160)}
    texts = [(i, "".join(rng.choices(chars + "a \n", k=rng.randrange(40)))) for i in range(60)] + [(60, ""), (61, None)]
    d = spark.createDataFrame(list(freq.items()), "word string, freq int")
    at = suffixes.places(spark.createDataFrame(texts, "id int, text string"), ("id",))
    assert at.count() == sum(len(t or "") for _, t in texts)
    best = {(r["id"], r["pos"]): (r["length"], r["freq"], -r["rank"]) for r in suffixes.best_words(at, suffixes.word_index(wordfreq.word_rank(d)), ("id",)).collect()}
    most = {(r["id"], r["pos"]): r["freq"] for r in suffixes.best_frequency(at, d, ("id",)).collect()}
    found = 0
    for i, t in texts:
        for p in range(len(t or "")):
            word, longest = plain_scores(freq, t[max(0, p - 12) : p], t[p])
            assert best.get((i, p + 1)) == word and most.get((i, p + 1)) == longest
            found += word is not None
            if longest:
                assert decode.Lexicon(freq).score(t[max(0, p - 12) : p], t[p])[:4] == (*(word or (0, 0, 0)), longest)
    assert found > 100


def plain_reading(items, lexicon):
    """Beams as whole token lists, every candidate scored in its context."""
    beams = [((0,) * 8, [])]
    for item in items:
        if isinstance(item, str):
            beams = [(s, [*t, item]) for s, t in beams]
            continue
        grown = []
        for s, tokens in beams:
            context = "".join(x for x in tokens if len(x) == 1)[-12:]
            grown += [(tuple(a + b for a, b in zip(s, lexicon.score(context, c))), [*tokens, c]) for c in item]
        beams = sorted(grown, key=lambda b: b[0], reverse=True)[:4]
    return beams[0][1]


def test_readings_of_conversations(spark, sf_dir):
    """All conversations in characters of which two share a code."""
    codes, lexicon = han.shape_list(spark, sf_dir), han.lexicon(spark, sf_dir)
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", han.written(F.col("text")).alias("text"))
    d = talk.select("text", encode.encoder(codes)(F.col("conv_id"), F.col("text")).alias("ids"))
    rows = d.select("text", decode.detokenizer(codes, lexicon)(F.col("ids")).alias("read")).collect()
    by_code = {}
    for c, code in codes:
        by_code.setdefault(code, []).append(c)
    of_char, known, right, total = dict(codes), decode.Lexicon(lexicon), 0, 0
    for r in rows:
        want = "".join(plain_reading([by_code[of_char[c]] if c in of_char else c for c in r["text"]], known))
        assert r["read"] == want
        right += sum(a == b for a, b in zip(want, r["text"]) if a in of_char)
        total += sum(c in of_char for c in r["text"])
    assert right > 0.7 * total


def test_outdone_words_reach_no_worker(spark, sf_dir, monkeypatch):
    """A character is there as often as any word that ends in it, so of the whole dictionary only the alphabet is held; other words decide and stay."""
    held, ends = [], suffixes._ends

    def counted(session, part, least, most):
        held.append(part.count())
        return ends(session, part, least, most)

    monkeypatch.setattr(suffixes, "_ends", counted)
    from inkflow.plans import queries

    assert queries.suffix_frequency(spark, sf_dir).count() > 0
    assert han.dictionary(spark, sf_dir).count() > 100 and sum(held) <= 26
    words = {"木": 5, "末": 2, "木末": 2, "本末": 3, "末本": 1, "札木": 6, "本末木": 7, "木札": 4}
    texts = ["木末本末木札木", "本末", "札", "", "木札木末本 本末木"]
    d = spark.createDataFrame([(w, [s]) for w, s in words.items()], "word string, score array<bigint>")
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert {r["word"] for r in suffixes.not_outdone(d, 1).collect()} == set(words) - {"木末"}
    got = {r["id"]: r["best"] for r in suffixes.best_scores(t, ("id",), d, 0, 12).collect()}
    for i, s in enumerate(texts):
        most = [max((words[w] for k in range(p + 1) if (w := s[k : p + 1]) in words), default=None) for p in range(len(s))]
        assert got[i] == [None if m is None else [m] for m in most]
