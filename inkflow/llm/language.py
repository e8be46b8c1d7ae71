"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import cut, small_batches, table

#: Buckets of the hashed n-grams, their lengths, and the additive smoothing.
BUCKETS, LENGTHS, SMOOTH = 1 << 16, (1, 2, 3), 0.1
#: Characters that a worker holds at once; languages that the broadcast matrix may have (256 KB each).
CHARS, LANGUAGES = 1 << 20, 512


def _letter(i: int) -> int:
    """The lower-case letter, or a blank for what is no letter."""
    c = chr(i)
    if not c.isalpha():
        return 32
    low = c.lower()
    return ord(low) if len(low) == 1 else i


_FOLD = np.array([_letter(i) for i in range(1 << 16)], np.uint64)


def folded(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _FOLD[np.minimum(c, 0xFFFF)]
    high = np.flatnonzero(c > 0xFFFF)
    if len(high):
        known, at = np.unique(c[high], return_inverse=True)
        out[high] = np.array([_letter(int(i)) for i in known], np.uint64)[at]
    return out


def buckets(c: np.ndarray, length: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each character from the ``length``-th on."""
    key = np.zeros(max(0, len(c) - length + 1), np.uint64)
    for i in range(length):
        key = key * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - length + 1 + i] + np.uint64(length)
    key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def stretches(texts: list):
    """Groups of (text index, letters): whole texts with blanks around, or parts of a long one that share their edges."""
    group, size, edge = [], 0, max(LENGTHS) - 1
    for i, t in enumerate(texts):
        if not t:
            continue
        for at in range(0, len(t), CHARS):
            c = folded(t[max(0, at - edge) : at + CHARS])
            ends = [np.full(1, 32, np.uint64)] if at == 0 else []
            group.append((i, np.concatenate([*ends, c, *([np.full(1, 32, np.uint64)] if at + CHARS >= len(t) else [])]), 0 if at == 0 else edge))
            size += len(c)
            if size >= CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (BUCKETS x languages) and log priors from all of ``docs(text, lang)``."""
    small_batches(docs.sparkSession)

    def run(batches):
        found: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for lang in langs:
                number[lang] = number.get(lang, 0) + 1
            for group in stretches(b.column(0).to_pylist()):
                for lang in {langs[i] for i, _, _ in group}:
                    n = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for k in LENGTHS:
                        parts = [buckets(c[max(0, skip - k + 1) :], k) for i, c, skip in group if langs[i] == lang]
                        n += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        for lang, n in sorted(number.items()):
            at = np.flatnonzero(found.get(lang, np.zeros(0)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at]), pa.array([n, *(found[lang][at] if len(at) else [])], pa.int64())], ["lang", "bucket", "n"])

    summed = docs.select("text", "lang").where("lang is not null").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = cut(summed)  # counted once; what follows reads the counts
    languages = sorted(r["lang"] for r in summed.where("bucket = -1").select("lang").collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix that is broadcast is bounded at {LANGUAGES}")
    number = F.element_at(F.create_map(*[x for i, l in enumerate(languages) for x in (F.lit(l), F.lit(i))]), F.col("lang")) if languages else F.lit(0)
    t = summed.select(number.alias("lang"), "bucket", "n").toArrow()  # three numbers for each of BUCKETS a language at most
    counts, priors = np.zeros((BUCKETS, max(1, len(languages)))), np.ones(max(1, len(languages)))
    lang = t.column("lang").to_numpy()
    bucket, n = t.column("bucket").to_numpy(), t.column("n").to_numpy()
    own = bucket >= 0
    counts[bucket[own], lang[own]] = n[own]
    priors[lang[~own]] = n[~own]
    counts += SMOOTH
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(priors / priors.sum())


def identify(docs: DataFrame, learned: Column, kind: str = "long") -> DataFrame:
    """(doc_id, lang_pred, score) per document of ``docs(doc_id, text, lang)``; learns where ``learned`` holds.

    Only rows with a lang are learned from. A null text, or one without any letter (of any plane of Unicode), is ``und`` with
    score 0, as is every text if nothing could be learned. ``score`` is the posterior of the predicted language; of equal
    languages the first by name wins. Texts of any length are read whole, in stretches. Repeated rows are predicted one by
    one; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    languages, log_p, priors = train(docs.where(learned))
    model = spark.sparkContext.broadcast((languages, log_p, priors))
    small_batches(spark)

    def run(batches):
        languages, log_p, priors = model.value
        for b in batches:
            texts = b.column(1).to_pylist()
            sums = np.tile(priors, (len(texts), 1))
            lettered = np.zeros(len(texts), bool)
            for group in stretches(texts):
                owners = np.array([i for i, _, _ in group])
                for i, c, _ in group:
                    lettered[i] |= bool((c != 32).any())
                for k in LENGTHS:
                    parts = [buckets(c[max(0, skip - k + 1) :], k) for _, c, skip in group]
                    sizes = np.array([len(p) for p in parts])
                    full = sizes > 0
                    if full.any():
                        starts = np.cumsum([0, *sizes[full]])[:-1]
                        np.add.at(sums, owners[full], np.add.reduceat(log_p[np.concatenate(parts)], starts, axis=0, dtype=np.float64))
            best = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            known = lettered & bool(languages)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([languages[j] if ok else "und" for j, ok in zip(best, known)]), pa.array(np.where(known, share, 0.0))], ["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2))
    found = identify(docs, (fold != 2) & F.col("doc_id").isNotNull())
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
