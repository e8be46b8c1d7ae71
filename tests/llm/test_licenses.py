"""The licence scan against a search phrase by phrase and a parser by recursive descent."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkflow.llm import licenses
from inkflow.llm.licenses import PHRASES, TERMS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_expression(text):
    """(spelling, labels, terms) or None, by recursive descent over all tokens."""
    tokens = []
    for m in re.finditer(r"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+:-]*)|(.))", text, re.S):
        if m[3]:
            break
        t = m[1] or m[2].rstrip(".:-")
        marked = m[2] and t != m[2]
        if not (marked and t in ("and", "or", "with")):  # an operator has no mark behind it
            tokens.append(t)
        if marked:
            tokens.append("<end>")
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom():
        t = peek()
        if t == "(":
            take()
            x = level(0)
            if x is None or peek() != ")":
                return None
            take()
            return x
        if t is None or t in ("and", "or", "with", ")", "<end>"):
            return None
        take()
        label = licenses.NAMES.get(re.sub(r"(\+|-only|-or-later)$", "", t))
        return t, {label} - {None}, TERMS.index(licenses.OF_LABEL.get(label, "permissive")) if label else TERMS.index("unknown")

    def level(k):
        if k == 3:
            return atom()
        x = level(k + 1)
        while x is not None and peek() == ("or", "and", "with")[k]:
            op = take()
            y = level(k + 1)
            if y is None:
                return None
            if op == "with":
                x = (f"({x[0]} with {y[0]})", x[1], TERMS.index("weak copyleft") if TERMS[x[2]] == "copyleft" else x[2])
            else:
                x = (f"({x[0]} {op} {y[0]})", x[1] | y[1], (min if op == "or" else max)(x[2], y[2]))
        return x

    return level(0)


def plain_findings(t):
    t = t or ""
    found = [(m.start(), m.end()) for m in WORD.finditer(lower(t))]
    words = [lower(t)[a:b] for a, b in found]
    every = []
    for i, p in enumerate(PHRASES):
        ws = p.words.split()
        every += [(k, k + len(ws), p) for k in range(len(words)) if words[k : k + len(ws)] == ws]
    notices = [x for x in every if x[2].label]
    kept = [x for x in notices if x[2].base or not any(y[0] <= x[0] and x[1] <= y[1] and y != x for y in notices)]
    base = [x for x in every if x[2].base]
    labels, terms, score, spelled = set(), [], 0.0, []
    for _, _, p in kept:
        labels.add(p.label)
        terms.append(TERMS.index(licenses.OF_LABEL.get(p.label, "permissive")))
        score = max(score, p.certainty)
    for a, b, p in sorted(every, key=lambda x: x[:2]):
        if p.label is None and (m := re.match(r"[\"']?[ \t]*[:=][ \t]*[\"']?", t[found[b - 1][1] :])):
            e = plain_expression(lower(t[found[b - 1][1] + m.end() :]))
            if e and e[1]:
                labels |= e[1]
                terms.append(e[2])
                spelled.append(e[0])
                score = 1.0
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min((x[0] for x in base), default=None), "last_word": max((x[0] for x in base), default=None),
        "base_labels": ",".join(sorted({x[2].label for x in base})), "labels": ",".join(sorted(labels)), "score": score,
        "terms": TERMS[max(terms)] if terms else None, "freedom": licenses.FREEDOM[TERMS[max(terms)]] if terms else None, "expressions": "; ".join(sorted(spelled)),
    }


def unordered(row):
    return row | {"expressions": "; ".join(sorted(row["expressions"].split("; ")))}


def some_texts(rng, n):
    bits = [w for p in PHRASES for w in [p.words, *p.words.split()]] + ["SPDX-License-Identifier: ", "License: ", "licence = \"", "MIT", "GPL-3.0-only", "Apache-2.0", "LGPL-2.1+", "CC-BY-NC-4.0", "Foo-1", "(", ")", " AND ", " or ", " WITH ", "Classpath-exception-2.0", "\n", ".", "é", "ÀB", "\U0001f970", "_", "-", ", ", "{", "\x7f"]
    bits += ["License: MIT", "SPDX-License-Identifier: (MIT or GPL-3.0-only WITH x)", "licence=GPL-2.0+ AND", "License-Expression: 'CC-BY-NC-4.0 OR ISC"] * 4
    return ["".join(b + rng.choice([" ", " ", "", "-", "\n"]) for b in rng.choices(bits, k=rng.randrange(25))) for _ in range(n)]


def test_base_is_fixed():
    assert {p.words: p.label for p in PHRASES if p.base} == BASE


def test_noise(spark):
    rng = random.Random(11)
    given = list(enumerate([*some_texts(rng, 600), None, "", " \n", "Released UNDER\nthe (MIT) License", "cc by nc cc by nc"]))
    d = spark.createDataFrame(given, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("labels", "score", "n_words", "terms")])
    got = {r["doc_id"]: unordered({k: v for k, v in r.asDict().items() if k != "doc_id"}) for r in licenses.licences(d).collect()}
    want = {i: unordered(plain_findings(t)) for i, t in given}
    for i, t in given:
        assert got[i] == want[i], (t, got[i], want[i])
    assert sum(bool(w["expressions"]) for w in want.values()) > 20 and sum(w["n_base"] > 0 for w in want.values()) > 20


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r.asDict() for r in licenses.op11_licenses(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        want = {"doc_id": r["doc_id"], **plain_findings(r["text"])}
        assert rows[r["doc_id"]] == want


@pytest.mark.parametrize("expression", ["MIT", "MIT or GPL-3.0-only", "a or MIT and GPL-2.0+", "(MIT or GPL-2.0 with x) and (ISC)", "((MIT)", "MIT)", "and MIT", "MIT or", "", "MIT. and GPL-3.0", "MIT isc", "with", "MIT with a with b", "(MIT or isc", "mit or (gpl-3.0 and", "() mit", "mit (isc)"])
def test_expressions(expression):
    got = licenses.evaluated(expression.lower().encode())
    want = plain_expression(expression.lower())
    assert (got and (got.spelled, set(got.labels), got.terms)) == want


def test_long_texts_in_pieces(spark):
    """Phrases across the borders of pieces are found once, and words count on."""
    text = "word " * 400_000 + "under the mit license " + "w " * 30 + "cc by nc"
    r = licenses.licences(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")).collect()
    assert [(x["n_words"], x["n_base"], x["first_word"], x["last_word"]) for x in r if x["doc_id"]] == [(400_037, 2, 400_000, 400_034)] * 2
    rng, a = random.Random(5), licenses.automaton()
    for t in some_texts(rng, 150):
        w = licenses.words_of(t)
        whole = sorted(licenses.places(a, *w))
        for piece in (1, 7, 64):
            assert sorted(licenses.places(a, *w, piece=piece)) == whole


def test_empty(spark):
    assert licenses.licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
