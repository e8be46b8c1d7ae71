"""Substring dedup by sliding sentence spans.

A text is cut into sentences; from every sentence a run of several consecutive ones starts, as many as hold
MIN_WORDS words. Runs are hashed and joined over all documents; sentences that a run covers are removed unless the
run is the first of its kind. Sums and least places are made before a run meets its copies, so a run that is
everywhere costs each task one row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm.common import BROADCAST_KEYS, cut, small_batches, table, text_hash

#: Sentences and words that a run holds at least. A longer sentence is cut where its own words say so.
MIN_SENTENCES, MIN_WORDS, LONG, EVERY = 2, 16, 24, 8
_END = re.compile(r"[.!?]+(?=\s)|\n|(?<=[。！？])")
_WORD = re.compile(r"\S+")
_MARKS = " .!?,;:"


def sentences(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, folded words) of each sentence; together they cover the text.

    A sentence ends after marks before a blank, or with a line. One of more than LONG words is cut after each
    word whose hash says so, wherever it stands, so that a passage without marks falls into equal pieces too.
    Folding is lower case, single blanks, and no marks at the ends.
    """
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end == at:
            continue
        words = text[at:end].lower().split()
        if len(words) <= LONG:
            out.append((at, end, len(words), " ".join(words).strip(_MARKS)))
        else:
            starts, last = [m.start() for m in _WORD.finditer(text, at, end)], 0
            if len(starts) != len(words):  # lower case may hold other blanks
                starts = [at] * len(words)
            cuts = [k + 1 for k, w in enumerate(words[:-1]) if xxhash.xxh32_intdigest(w.strip(_MARKS)) % EVERY == 0 and starts[k + 1] > at]
            for k in [*cuts, len(words)]:
                out.append((starts[last] if last else at, starts[k] if k < len(words) else end, k - last, " ".join(words[last:k]).strip(_MARKS)))
                last = k
        at = end
    return out


def runs(text: str) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the run that starts at each sentence with words: MIN_SENTENCES or more, MIN_WORDS or more words."""
    s = [x for x in sentences(text) if x[2]]
    digests = [xxhash.xxh64_digest(x[3]) for x in s]
    out, j, held = [], 0, 0
    for i, x in enumerate(s):
        while j < len(s) and (j - i < MIN_SENTENCES or held < MIN_WORDS):
            held += s[j][2]
            j += 1
        if held < MIN_WORDS or j - i < MIN_SENTENCES:
            break
        out.append((xxhash.xxh64_intdigest(b"".join(digests[i:j])), x[0], s[j - 1][1]))
        held -= x[2]
    return out


def spans(docs: DataFrame) -> DataFrame:
    """(run, doc_id, text_hash, start, end, again) of all runs in the texts of ``docs(doc_id, text)``; again: the text had this run before."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            owner, found, again = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                r, seen = runs(t or ""), set()
                owner += [i] * len(r)
                found += r
                for h, _, _ in r:
                    again.append(h in seen)
                    seen.add(h)
            h = np.array([x[0] for x in found], np.uint64).view(np.int64)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(owner), b.column(1).take(owner), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array(again, pa.bool_())], ["run", "doc_id", "text_hash", "start", "end", "again"])

    d = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return d.mapInArrow(run, f"run long, doc_id {d.schema['doc_id'].dataType.simpleString()}, text_hash long, start int, end int, again boolean")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): what the non-first repeated runs of each document cover, in order."""
    s = spans(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # The repeated runs are cut off as a table of their own: a join of it with the spans can be split where one run is everywhere.
    first = cut(s.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("run", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")))
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    later = s.join(first.hint("shuffle_hash"), "run").where(F.col("again") | elsewhere).select("doc_id", "text_hash", "start", "end")
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc, text, n_removed) per document: ``text`` without the sentences that a non-first repeated run covers.

    The first of equal runs is that of the least doc_id (a null one comes after all), then the least text hash, then
    the least place. A row is known by its doc_id and text: unlike texts that share a doc_id, or have none, are
    documents of their own. Of rows alike in both, all but the one of the least hash of all columns lose every run they hold. Null
    texts stay null; texts of less than a run stay as they are; texts of any length are read whole. Other columns
    pass through. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    cuts = removals(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").hint("shuffle_hash")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_hash(F.col("text")).alias("_text"))
    named = lambda k: k.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = lambda k: d["doc"]["doc_id"].eqNullSafe(k["_id"]) & (d["_text"] == k["_hash"])
    copied = named(cut(docs.where("text is not null").groupBy("doc_id", text_hash(F.col("text")).alias("text_hash")).count().where("count > 1")))
    plain, copies = d, None
    if not copied.isEmpty():
        copied = F.broadcast(copied) if copied.count() <= BROADCAST_KEYS else copied
        nth = F.row_number().over(Window.partitionBy("doc.doc_id", "_text").orderBy(F.xxhash64("doc")))
        copies = cut(d.join(copied, same(copied), "left_semi").withColumn("nth", nth))
        plain = d.join(copied, same(copied), "left_anti").union(copies.where("nth = 1").drop("nth"))
        copies = copies.where("nth > 1").select("doc", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"))).alias("spans"))
    parts = plain.join(cuts, plain["doc"]["doc_id"].eqNullSafe(cuts["_id"]) & (plain["_text"] == cuts["_hash"]), "left").select("doc", "spans")
    parts = (parts.union(copies) if copies is not None else parts).select("doc", "spans", F.col("doc.text").alias("text"), F.lit(0).cast("long").alias("n_removed"))

    def run(batches):
        for b in batches:
            texts, n = [], []
            for t, cut in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                kept, removed, at = [], 0, 0
                whole = bool(cut) and cut[0]["end"] < 0
                for x, y in [(x, y) for _, x, y in runs(t or "")] if whole else [(x["start"], x["end"]) for x in cut or ()]:
                    a, z = max(x, at), min(y, len(t or ""))
                    if z > a:
                        kept.append(t[at:a])
                        removed, at = removed + z - a, z
                texts.append(t if t is None or not removed else _joined([*kept, t[at:]]))
                n.append(removed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["doc", "text", "n_removed"])

    return parts.mapInArrow(run, parts.select("doc", "text", "n_removed").schema)


def _joined(parts: list[str]) -> str:
    """The parts in order, with a blank where two words would meet."""
    out: list[str] = []
    for p in filter(None, parts):
        out += [" "] * bool(out and not out[-1][-1].isspace() and not p[0].isspace()) + [p]
    return "".join(out)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc.doc_id", "text", F.col("n_removed"), (F.col("n_removed") > 0).alias("changed"))
