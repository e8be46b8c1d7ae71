"""Toxicity by weak supervision.

Voters are induced from a bounded sample of labelled texts: lexicon voters (the text holds a word, or a word with a
certain beginning, so that one voter speaks for a family of words) and pattern voters (its form). A voter says
"toxic" or abstains. Chance is measured on shuffled labels: a feature votes only if it stands out more than any
feature does there. That is all that labels are used for: a generative
label model estimates the voters' accuracies, and their correlations as a tree, from their votes alone, and its posterior labels train a
linear classifier, which scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import cut, small_batches, table

#: Labelled rows that are sampled, features that are looked at, voters.
SAMPLE, FEATURES, VOTERS = 20_000, 4096, 256
#: How much likelier under label 1 a feature must be; shuffles of the labels; lengths of word beginnings.
LIFT, SHUFFLES, PREFIX = 4.0, 3, (4, 5, 6, 7, 8)
#: In what share of the texts that it is found in a voter has to be right.
RIGHT = 0.85
#: As how many votes a voter's accuracy counts that is believed beforehand; the posterior of a row without votes.
WEIGHT, SILENT = 50.0, 0.02
WORD, UPPER, MARK = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z]"), re.compile(r"[^\w\s]")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(words: set[str], marks: set[str]) -> set[str]:
    """Words, word beginnings (of any word, and of two or more) and patterns of form."""
    out = {f"w:{w}" for w in words} | marks
    for n in PREFIX:
        seen = Counter(w[:n] for w in words if len(w) > n)
        out.update(f"{n}:{p}" for p in seen)
        out.update(f"{n}x:{p}" for p, k in seen.items() if k > 1)
    return out


def form(text: str | None) -> set[str]:
    """Patterns of form: much upper case, many marks, shouting, and a short text."""
    if not text:
        return set()
    upper, marks = len(UPPER.findall(text)), len(MARK.findall(text))
    seen = {"upper": upper > 0.3 * len(text), "marks": marks > 0.1 * len(text), "shout": "!!" in text, "short": len(text) < 200}
    return {f"form:{k}" for k, v in seen.items() if v}


def label_model(votes: np.ndarray, trust: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of label 1 for each row of 0/1 ``votes`` (0: the voter abstains), from the votes and what is believed of the voters.

    A vote is right with its voter's accuracy, which EM estimates: ``trust`` is believed of a voter beforehand, as WEIGHT votes seen. An
    abstention says nothing, and no vote speaks against its label. Voters that vote together are no independent witnesses: in a tree (the
    heaviest spanning tree of the conditional mutual information, found anew while the labels still move) each voter has one accuracy
    where the voter above it votes too and one where it is silent, and adds only what it says beyond that one. A row without votes is
    held to be 0.
    """
    v = votes.astype(np.float32)
    covered = votes.any(axis=1)
    post = np.where(covered, 1 - np.exp(v @ np.log1p(-np.clip(trust, 0, 0.99))), SILENT)
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    right = lambda ones, of: (ones + WEIGHT * trust) / (of + WEIGHT)
    for step in range(rounds):
        if step % 10 == 0:
            parent = _tree(v, post)
            up = np.where(parent < 0, 0, parent)
            given = np.where(parent < 0, 0, v[:, up]).astype(np.float32)
            both = v * given
            own, joint = v.sum(axis=0, dtype=np.float64), both.sum(axis=0, dtype=np.float64)
        before, pi = post, post.mean()
        own1, joint1 = post @ v, post @ both
        alone = np.maximum(0, logit(right(own1 - joint1, own - joint)) - logit(pi))
        beside = np.maximum(0, logit(right(joint1, joint)) - logit(right(own1, own)[up]))
        post = np.where(covered, 1 / (1 + np.exp(-(logit(pi) + v @ alone + both @ (beside - alone)))), SILENT)
        if np.abs(post - before).max() < 1e-4:
            break
    return post


def _tree(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    n, m = v.shape
    gain = np.zeros((m, m))
    for w in (1 - post, post):
        total = w.sum() + 1e-9
        p11 = ((v * w.astype(np.float32)[:, None]).T @ v).astype(np.float64) / total
        p1 = np.diag(p11)
        for a in (0, 1):
            for b in (0, 1):
                joint = p11 if a and b else p1[:, None] - p11 if a else p1[None, :] - p11 if b else 1 - p1[:, None] - p1[None, :] + p11
                alone = (p1 if a else 1 - p1)[:, None] * (p1 if b else 1 - p1)[None, :]
                joint = np.clip(joint, 1e-12, 1)
                gain += total / n * joint * np.log(joint / np.clip(alone, 1e-12, 1))
    parent, inside = np.full(m, -1), [0] if m else []
    while len(inside) < m:
        out = np.setdiff1d(np.arange(m), inside)
        k = np.unravel_index(gain[np.ix_(inside, out)].argmax(), (len(inside), len(out)))
        if gain[inside[k[0]], out[k[1]]] > 0.005:
            parent[out[k[1]]] = inside[k[0]]
        inside.append(int(out[k[1]]))
    return parent


def linear_classifier(rows: list[np.ndarray], width: int, y: np.ndarray, rounds: int = 600, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features (their indices) with soft labels, by accelerated gradient steps."""
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, b = np.zeros(width, np.float32), float(np.log(np.clip(y.mean(), 1e-3, 0.999) / (1 - np.clip(y.mean(), 1e-3, 0.999))))
    step_w, step_b = np.full(width, 1e-6, np.float32), 1e-6
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y).astype(np.float32)
        g, gb = x.T @ e / len(y) + ridge * w, float(e.mean())
        step_w, step_b = step_w + g * g, step_b + gb * gb
        w, b = w - 0.5 * g / np.sqrt(step_w), b - 0.5 * gb / np.sqrt(step_b)
    return w, b


def surprise(a: Column, b: Column, n1: int, n0: int) -> Column:
    """G squared of a feature that ``a`` of ``n1`` texts of label 1 and ``b`` of ``n0`` of label 0 hold; 0 if it is no likelier under 1."""
    share = n1 / (n0 + n1)
    held = a + b
    g = 2 * (a * F.log((a + 0.01) / (held * share)) + b * F.log((b + 0.01) / (held * (1 - share))))
    return F.when((a + 0.5) / (n1 + 1) > LIFT * (b + 0.5) / (n0 + 1), g).otherwise(0.0)


def sampled(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(copy, words, marks, y, at) of the distinct texts of at most SAMPLE labelled rows; y is the label most copies have, at a seeded place."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_id"), "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))

    def run(batches):
        for b in batches:
            out: list = [[], [], []]
            for t in b.column(0).to_pylist():
                words, marks = sorted(words_of(t)), sorted(form(t))
                out[0].append(xxhash.xxh64_intdigest(" ".join([*words, "", *marks]).encode("utf-8", "replace")) - (1 << 63))
                out[1].append(words)
                out[2].append(marks)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.string())), b.column(1)], ["copy", "words", "marks", "toxic"])

    # Copies of a text count once, so that its own words don't pass for a lexicon.
    seen = texts.mapInArrow(run, "copy long, words array<string>, marks array<string>, toxic int").groupBy("copy")
    seen = seen.agg(F.first("words").alias("words"), F.first("marks").alias("marks"), (F.avg("toxic") >= 0.5).cast("int").alias("y"))
    return seen.withColumn("at", F.pmod(F.xxhash64("copy", F.lit(seed)), F.lit(1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 67) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias, from at most SAMPLE rows of ``labels(doc_id, toxic)`` and their texts."""
    spark = docs.sparkSession
    small_batches(spark)
    seen = cut(sampled(docs, labels, seed))
    n = dict(seen.groupBy("y").count().collect())
    if not n.get(1) or not n.get(0):
        return {}, 4.0 if n.get(1) else -4.0
    n1, n0 = n[1], n[0]
    limit = int((1 << 30) * n1 / (n0 + n1))

    def counted(batches):
        """How many texts of the task hold each feature, under label 1, in all, and under label 1 of each shuffle."""
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for words, marks, y, at in zip(*(b.column(k).to_pylist() for k in ("words", "marks", "y", "at"))):
                one = np.array([y, 1, *((at * m % (1 << 30)) < limit for m in (1, 5, 17)[:SHUFFLES])], np.int32)
                for f in features(set(words), set(marks)):
                    if f in total:
                        total[f] += one
                    else:
                        total[f] = one.copy()
        names, sums = list(total), np.array([*total.values()], np.int32).reshape(-1, 2 + SHUFFLES)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(sums[:, k]) for k in range(2 + SHUFFLES))], ["f", "a", "n", *(f"s{k}" for k in range(SHUFFLES))])

    sums = ["a", "n", *(f"s{k}" for k in range(SHUFFLES))]
    each = seen.mapInArrow(counted, "f string, " + ", ".join(f"{c} int" for c in sums)).groupBy("f").agg(*[F.sum(c).alias(c) for c in sums]).where("n > 2")
    chance = [surprise(F.col(f"s{k}"), F.col("n") - F.col(f"s{k}"), n1, n0).alias(f"s{k}") for k in range(SHUFFLES)]
    each = cut(each.select("f", surprise(F.col("a"), F.col("n") - F.col("a"), n1, n0).alias("sure"), F.greatest(*chance, F.lit(0.0)).alias("chance")))
    least = each.agg(F.max("chance")).first()[0] or 0.0
    ranked = each.where(F.col("sure") > least).orderBy(F.col("sure").desc(), F.length("f").desc(), "f").limit(FEATURES).collect()
    at = {r["f"]: i for i, r in enumerate(ranked)}

    def located(batches):
        for b in batches:
            found = [sorted(at[f] for f in features(set(w), set(m)) & at.keys()) for w, m in zip(b.column("words").to_pylist(), b.column("marks").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("copy"), b.column("y"), pa.array(found, pa.list_(pa.int32()))], ["copy", "y", "x"])

    held = sorted((r["copy"], r["y"], r["x"]) for r in seen.mapInArrow(located, "copy long, y int, x array<int>").toLocalIterator())
    y = np.array([r[1] for r in held])
    x = np.zeros((len(held), len(at)), bool)
    for i, r in enumerate(held):
        x[i, r[2]] = True
    chosen = voters_of([*at], x, y, least)
    names, x = [[*at][k] for k in chosen], x[:, chosen]
    if not names:
        return {}, -4.0
    w, b = linear_classifier([np.flatnonzero(r) for r in x], len(names), label_model(x, accuracy(x, y)))
    return {f: float(v) for f, v in zip(names, w)}, float(b)


def accuracy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How often each feature is right where it is found, half a text of either label added."""
    return (x[y > 0].sum(axis=0) + 0.5) / (x.sum(axis=0) + 1)


def voters_of(names: list[str], x: np.ndarray, y: np.ndarray, least: float) -> list[int]:
    """Features that become voters, strongest first: of a family (one begins like the other) only what stands out where the stronger ones are silent."""
    out: list[int] = []
    good = accuracy(x, y) >= RIGHT
    for k, f in enumerate(names):
        if not good[k]:
            continue
        kind, own = f.split(":", 1)
        family = [j for j in out if kind != "form" and not names[j].startswith("form:") and (own.startswith(names[j].split(":", 1)[1]) or names[j].split(":", 1)[1].startswith(own))]
        rest = ~x[:, family].any(axis=1) if family else np.ones(len(y), bool)
        a, n, n1, n0 = (x[rest, k] & (y[rest] > 0)).sum(), x[rest, k].sum(), (y[rest] > 0).sum(), (y[rest] == 0).sum()
        if not a or not n0 or (a + 0.5) / (n1 + 1) <= LIFT * (n - a + 0.5) / (n0 + 1):
            continue
        share, b = n1 / (n1 + n0), n - a
        if 2 * (a * np.log((a + 0.01) / (n * share)) + b * np.log((b + 0.01) / (n * (1 - share)))) > least:
            out.append(k)
            if len(out) == VOTERS:
                break
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) per document: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no features and get the score of that; texts of any length are read whole; repeated
    rows are scored one by one and count once in training, where copies of unlike labels take that of most (label 1
    if equal); labels of null id or value are not used, and the highest of an id is; without labels of both kinds all
    scores are alike. Other columns of ``docs(doc_id, text)`` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    weights, bias = fit(docs, labels)
    model = spark.sparkContext.broadcast(weights)

    def run(batches):
        weights = model.value
        words = {f[2:]: w for f, w in weights.items() if f.startswith("w:")}
        starts = {}
        for n in PREFIX:
            once, twice = ({f.split(":", 1)[1]: w for f, w in weights.items() if f.startswith(k)} for k in (f"{n}:", f"{n}x:"))
            if once or twice:
                starts[n] = once, twice, once.keys() | twice.keys()
        forms = {f: w for f, w in weights.items() if f.startswith("form:")}
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                own = words_of(t)
                s = bias + sum(words[w] for w in sorted(own & words.keys()))
                for n, (once, twice, known) in starts.items():
                    for p, k in sorted(Counter(p for w in own if len(w) > n and (p := w[:n]) in known).items()):
                        s += once.get(p, 0.0) + (twice.get(p, 0.0) if k > 1 else 0.0)
                out.append(s + sum(forms.get(f, 0.0) for f in form(t)) if forms else s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -50, 50))))], ["doc_id", "score"])

    small_batches(spark)
    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold: Column = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").where(fold != 0)
    found = toxicity(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
