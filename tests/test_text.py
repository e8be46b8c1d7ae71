"""Script conversion by tries and segmentation with hidden states, against plain versions."""

import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkflow.functions import text
from inkflow.functions.text import STATES, UNSEEN, HiddenStates


def plain_rewrite(t, table):
    out, i = "", 0
    while i < len(t):
        best = max((k for k in table if k and t.startswith(k, i)), key=len, default=None)
        out += table[best] if best else t[i]
        i += len(best) if best else 1
    return out


def test_longest_entries_in_stages(spark):
    rng = random.Random(2)
    letters = "軟软件发頭发é abc\n.^]-\\"
    stages = [{"".join(rng.choices(letters, k=rng.randrange(1, 5))): "".join(rng.choices(letters, k=rng.randrange(3))) for _ in range(40)} for _ in range(3)]
    given = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300)] + [None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in given], "t string").coalesce(1).select(text.script_converter(*stages)(F.col("t"))).collect()]
    want = []
    for t in given:
        for s in stages if t is not None else ():
            t = plain_rewrite(t, s)
        want.append(t)
    assert got == want
    assert text.Trie({}).rewrite("abc") == "abc" and text.Trie({"": "x"}).rewrite("abc") == "abc"


def test_cost_does_not_grow_with_the_table():
    """500 times as many entries: a text costs about as much (an alternation of all entries costs in proportion)."""
    rng = random.Random(4)
    common = [chr(0x4E00 + i) for i in range(3000)]
    def table(n):
        return {"".join(rng.choices(common, k=rng.randrange(2, 5))): "x" for _ in range(n)}
    t = "".join(rng.choices(common, k=100_000))
    took = {}
    for n in (100, 50_000):
        trie = text.Trie(table(n))
        took[n] = min(_timed(trie, t) for _ in range(3))
    assert took[50_000] < 40 * took[100] and took[50_000] < 1.0  # the small table's first characters are rare in the text


def _timed(trie, t):
    began = time.perf_counter()
    trie.rewrite(t)
    return time.perf_counter() - began


def plain_states(t, h):
    """The best of all sequences of states that make words."""
    def score(states):
        s = h.start.get(states[0], UNSEEN) + h.emit.get((states[0], t[0]), UNSEEN)
        for a, b, c in zip(states, states[1:], t[1:]):
            s += h.step.get((a, b), UNSEEN) + h.emit.get((b, c), UNSEEN)
        return s
    valid = [s for s in itertools.product(STATES, repeat=len(t)) if s[0] in "BS" and s[-1] in "ES" and all(a in text.COMES_AFTER[b] for a, b in zip(s, s[1:]))]
    return max(map(score, valid)), score


def some_states(rng, chars):
    log = lambda: math.log(rng.random())
    return HiddenStates({"B": log(), "S": log()}, {(p, s): log() for s, before in text.COMES_AFTER.items() for p in before}, {(s, c): log() for s in STATES for c in chars if rng.random() < 0.9})


def test_hidden_states_against_all_sequences():
    rng = random.Random(6)
    for _ in range(60):
        chars = "木末本札术"
        h, t = some_states(rng, chars), "".join(rng.choices(chars + "朱", k=rng.randrange(1, 7)))
        words = h.words(t)
        assert "".join(words) == t
        best, score = plain_states(t, h)
        of = [s for w in words for s in ("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E")]
        assert score(of) == pytest.approx(best)
    assert h.words("") == []


def test_tables_from_words(spark):
    d = spark.createDataFrame([("木", 6), ("末本", 3), ("末札本", 1), ("", 5), ("本", 0), (None, 2)], "word string, freq int")
    h = text.hidden_states(d)
    assert h.start["B"] == pytest.approx(math.log(0.4)) and h.start["S"] == pytest.approx(math.log(0.6)) and h.start["M"] == UNSEEN
    assert h.emit == {("S", "木"): 0.0, ("B", "末"): 0.0, ("M", "札"): 0.0, ("E", "本"): 0.0}
    assert h.step["B", "E"] == pytest.approx(math.log(4 / 5)) and h.step["M", "M"] == pytest.approx(math.log(1 / 5)) and h.step["E", "S"] == pytest.approx(math.log(0.6))
    assert h.words("末本木末札本") == ["末本", "木", "末札本"]


def test_unknown_words(spark, sf_dir):
    """All documents, their letters written in CJK characters: words of the dictionary stay, runs of single ones are cut by states."""
    han = "".join(chr(0x6728 + i) for i in range(26))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", han).alias("text"))
    given = {r["doc_id"]: r["text"] for r in d.collect()}
    runs = [w for t in given.values() for w in re.findall("[木-杁]+", t or "")]
    freq = {w: runs.count(w) for w in sorted(set(runs))[::7]} | {"木木": 0}
    h = text.hidden_states(spark.createDataFrame(list(freq.items()), "word string, freq int"))
    got = {r["doc_id"]: r["words"] for r in d.select("doc_id", text.segmenter(freq, h)(F.col("text")).alias("words")).collect()}
    longest, total = max(map(len, freq)), sum(freq.values())
    unknown = 0
    for i, t in given.items():
        want = []
        for p in re.findall(r"[㐀-䶿一-鿿豈-﫿]+|[^\W㐀-䶿一-鿿豈-﫿]+|[\s\S]", t or ""):
            path = text.best_path(p, freq, longest, total) if "㐀" <= p[0] <= "鿿" else [p]
            k = 0
            while k < len(path):
                j = k
                while j < len(path) and len(path[j]) == 1:
                    j += 1
                if j > k:
                    together = "".join(path[k:j])
                    cut = path[k:j] if j - k == 1 or freq.get(together) else h.words(together)
                    unknown += any(len(w) > 1 for w in cut)
                    want += cut
                    k = j
                else:
                    want.append(path[k])
                    k += 1
        assert got[i] == want
    assert unknown > 100
    other = [r[0] for r in spark.createDataFrame([("가나 木木ab", )], "t string").select(text.segmenter({"木": 1})(F.col("t"))).collect()]
    assert other == [["가나", " ", "木", "木", "ab"]]
