"""The filter audit against every order applied to every document, and its polynomials by hand."""

import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from inkflow.llm import audit

DOC = "doc_id long, text string, source string"


def plain_audit(rows, labels):
    """Rows of the audit, filter by filter and document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))
    failing = []
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        failing.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, all_removed = {}, defaultdict(int)
    for part in {p for p, *_ in failing}:
        held = [x for x in failing if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                fails = sum(c in x[1] for x in held)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(x[1] == {c} for x in held), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                all_removed[part, c] += len(gone)
    return {(*k, *v, all_removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(docs, labels):
    return [tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in audit.filter_audit(docs, labels).collect()]


def some_rows(rng, n):
    words = ["the", "old", "Mill", "A", "RIVER", "runs", "#", "past", "é", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choices(words[: rng.randrange(3, len(words))], k=rng.choice([0, 3, 49, 50, 51, 90]))) for _ in range(40)] + [None, "", "\t\n ", "word " * 70_000]
    return [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "a", "b", "é"])) for _ in range(n)]


def test_every_order(spark):
    rng = random.Random(12)
    rows = some_rows(rng, 260)
    rows += [(7, "same text", "a")] * 5 + [(6, "same text", "b"), (None, "same text", "a"), (None, "same text", "a")] + rows[:20]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    d = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in ("mask", "part", "digest", "n", "own", "good", "salt")])
    found = got(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows, labels)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(docs, labels) == []
    rows = [(1, None, None)]
    assert set(got(spark.createDataFrame(rows, DOC), labels)) == plain_audit(rows, [])


@pytest.mark.parametrize("k", [1, 3, 5])
def test_polynomial(k):
    rng = random.Random(k)
    counts = [rng.randrange(9) for _ in range(1 << k)]
    p = audit.removal_polynomial(counts, k)
    assert audit.corners(p, k) == [sum(c for m, c in enumerate(counts) if m & s) for s in range(1 << k)]
    for i in range(k):
        assert audit.shapley(p, i) == sum((Fraction(c, m.bit_count()) for m, c in enumerate(counts) if m >> i & 1), Fraction(0))
