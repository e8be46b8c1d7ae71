"""Word frequencies and ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions.batches import slices
from inkflow.functions.text import is_cjk, is_cjk_word, is_vocabulary_word

TOP, COMMON_CHARS, COMMON_WORDS = 1000, 3500, 20_000
#: Bytes of lists, eight for each word, that are counted at once.
SLICE_BYTES = 1 << 22


def _counted(words: DataFrame) -> DataFrame:
    """(word, n, source_ord, doc_id, place): how often each word is in a slice of a task's lists, and where first; a row for each, none for a place."""
    words = words.select("source_ord", "doc_id", "words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, doc, lists in slices(tuple(b.columns), SLICE_BYTES):
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().dictionary_encode()
                if not len(flat):
                    continue
                order = pc.sort_indices(pa.table({"s": source, "d": doc}), sort_keys=[("s", "ascending"), ("d", "ascending")], null_placement="at_start").to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                which = flat.indices.fill_null(len(flat.dictionary)).to_numpy(zero_copy_only=False)
                longest = int(sizes.max())
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = np.full(len(flat.dictionary) + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, which, np.repeat(rank, sizes) * longest + place)
                n, first = np.bincount(which, minlength=len(first))[:-1], first[:-1]
                row = pa.array(order[first // longest])
                yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(n, pa.int64()), source.take(row), doc.take(row), pa.array(first % longest, pa.int32())], ["word", "n", "source_ord", "doc_id", "place"])

    kind = {f.name: f.dataType.simpleString() for f in words.schema}
    return words.mapInArrow(count, f"word string, n long, source_ord {kind['source_ord']}, doc_id {kind['doc_id']}, place int")


def word_counts(words: DataFrame, written: Callable[[Column], Column] | None = None) -> DataFrame:
    """``words(source_ord, doc_id, words)`` -> (word, n, first): vocabulary words, how often and where first.

    Words are counted in their lists, slice by slice, before rows are made of them. With ``written`` they are counted as they stand, and each distinct one
    is then written so; a writing must keep the length of words. What a word costs much for, its writing and the look for numbers, is done once for
    each distinct word.
    """
    may_be = (lambda w: F.char_length(w) >= 2) if written else (lambda w: (F.char_length(w) >= 2) & (F.ascii(F.substring(w, 1, 1)) > 127))
    w = _counted(words).withColumn("word", F.trim("word"))
    counts = w.where(may_be(F.col("word"))).groupBy("word").agg(F.sum("n").alias("n"), F.min(F.struct("source_ord", "doc_id", "place")).alias("first"))
    if written:
        counts = counts.groupBy(written(F.col("word")).alias("word")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return counts.where(is_vocabulary_word(F.col("word")))


def top_words(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(word, n) of the most frequent; of equal ones those met first."""
    return counts.orderBy(F.col("n").desc(), F.col("first")).limit(k).select("word", "n")


def loaded_sources(docs: DataFrame) -> int:
    """Sources with documents; none is an error."""
    n = docs.where("source is not null").select("source").distinct().count()
    if not n:
        raise ValueError("no source could be loaded")
    return n


def char_rank(words: DataFrame, most: int = COMMON_CHARS) -> DataFrame:
    """``words(word, freq)`` -> (char, rank) of the most frequent CJK characters, from 0."""
    c = words.where(is_cjk(F.col("word")) & (F.col("freq") > 0))
    rank = F.row_number().over(Window.orderBy(F.col("freq").desc(), "word")) - 1
    return c.select(F.col("word").alias("char"), rank.alias("rank")).where(F.col("rank") < most)


def word_rank(words: DataFrame, most: int = COMMON_WORDS) -> DataFrame:
    """(word, freq, rank) of the most frequent CJK words of 2 to 4 characters; longer before shorter, then by code point."""
    c = words.where(is_cjk_word(F.col("word")) & (F.col("freq") > 0))
    rank = F.row_number().over(Window.orderBy(F.col("freq").desc(), F.char_length("word").desc(), "word")) - 1
    return c.select("word", "freq", rank.alias("rank")).where(F.col("rank") < most)


def words_by_last_char(ranked: DataFrame) -> DataFrame:
    """(char, words): the ranked words that end in each character, in rank order."""
    entry = F.struct("rank", "word", "freq")
    return ranked.groupBy(F.right("word", F.lit(1)).alias("char")).agg(F.array_sort(F.collect_list(entry)).alias("words"))
