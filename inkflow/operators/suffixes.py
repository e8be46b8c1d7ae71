"""Words that end at a place of a text, found by joins with an index of words instead of a look at every word.

A context that ends in the first characters of a word, and the candidate that is its last one, are together a piece of
text that ends at the candidate's place. So each place asks with its few pieces, one for each length that words have, and the index
answers by equality of (last character, beginning).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.functions.batches import arrow_function
from inkflow.functions.text import WORD_MOST
from inkflow.operators.decode import CONTEXT
from inkflow.plans.lineage import cut

#: Rows of an index that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of a dictionary that a pass over the texts holds.
BLOCK_WORDS = 250_000


def places(texts: DataFrame, key: tuple[str, ...], text: str = "text", most: int = CONTEXT) -> DataFrame:
    """(key, pos, context, char): each character of each text, from 1, with up to ``most`` characters before it."""
    at = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.struct(i.alias("pos"), F.substring(text, F.greatest(F.lit(1), i - most), F.least(i - 1, F.lit(most))).alias("context"), F.substring(text, i, F.lit(1)).alias("char")))
    return texts.where(F.char_length(text) > 0).select(*key, F.explode(at).alias("x")).select(*key, "x.pos", "x.context", "x.char")


def word_index(ranked: DataFrame) -> DataFrame:
    """``ranked(word, freq, rank)`` -> (last, beginning, length, freq, rank)."""
    n = F.char_length("word")
    return ranked.select(F.right("word", F.lit(1)).alias("last"), F.left("word", n - 1).alias("beginning"), n.alias("length"), "freq", "rank")


def _asked(at: DataFrame, least: int, most: int) -> DataFrame:
    """Each place once for each length that its context allows: the ``least`` to ``most`` characters before it."""
    size = F.least(F.char_length("context"), F.lit(most))
    ends = F.when(size >= least, F.transform(F.sequence(F.lit(least), F.greatest(size, F.lit(least))), lambda k: F.right(F.col("context"), k)))
    return at.withColumn("beginning", F.explode(ends))


def best_words(at: DataFrame, index: DataFrame, key: tuple[str, ...], most: int = WORD_MOST) -> DataFrame:
    """(key, pos, length, freq, rank) of the best word that ends at each place: the longest, then the most frequent, then the first ranked.

    ``at(key, pos, context, char)``. Places where no word ends have no row.
    """
    i = index.select(F.col("last").alias("_last"), F.col("beginning").alias("_beginning"), "length", "freq", "rank")
    i = F.broadcast(i) if i.count() <= BROADCAST_ROWS else i
    found = _asked(at, 1, most - 1).join(i, (F.col("char") == F.col("_last")) & (F.col("beginning") == F.col("_beginning")))
    best = F.max(F.struct("length", "freq", (-F.col("rank")).alias("r")))
    return found.groupBy(*key, "pos").agg(best.alias("b")).select(*key, "pos", "b.length", "b.freq", (-F.col("b.r")).alias("rank"))


def best_frequency(at: DataFrame, dictionary: DataFrame, key: tuple[str, ...], most: int = CONTEXT) -> DataFrame:
    """(key, pos, freq): the greatest frequency of the candidate with any end of its context, the empty one too. None in the dictionary: no row."""
    d = dictionary.where(F.char_length("word") <= most + 1).select(F.right("word", F.lit(1)).alias("_last"), F.left("word", F.char_length("word") - 1).alias("_beginning"), "freq")
    d = F.broadcast(d) if d.count() <= BROADCAST_ROWS else d
    found = _asked(at, 0, most).join(d, (F.col("char") == F.col("_last")) & (F.col("beginning") == F.col("_beginning")))
    return found.groupBy(*key, "pos").agg(F.max("freq").alias("freq"))


def not_outdone(scores: DataFrame, shortest: int) -> DataFrame:
    """``scores(word, score)`` without words that never decide: where one ends, its last ``shortest`` characters end too, and are a word that scores as much."""
    n = F.char_length("word")
    ends = scores.where(n == shortest).groupBy(F.col("word").alias("_end")).agg(F.max("score").alias("_most"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    both = scores.join(ends, F.right("word", F.lit(shortest)) == F.col("_end"), "left")
    return both.where((n == shortest) | F.col("_most").isNull() | (F.col("score") > F.col("_most"))).select("word", "score")


def best_scores(texts: DataFrame, key: tuple[str, ...], scores: DataFrame, least: int, most: int, text: str = "text") -> DataFrame:
    """(key, best): for each place of each text the greatest score of a word that ends there, with ``least`` to ``most`` characters before it.

    ``scores(word, score)``, a score is a list of numbers; places where no word ends have none. Places stay in their text, so that no row is made
    of them and none is shuffled; a dictionary above BLOCK_WORDS is taken in blocks, a pass over the texts for each. Words that a shorter one
    outdoes are left out before, by a join, so they reach neither the driver nor a worker. Rows of one key count as one.
    """
    held = cut(not_outdone(cut(scores.where(F.char_length("word").between(least + 1, most + 1))), least + 1))
    blocks = max(1, -(-held.count() // BLOCK_WORDS))
    greater = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(y.isNull() | (x >= y), x).otherwise(y))
    one_row = texts.groupBy(*key).count().where("count > 1").isEmpty()
    out = texts
    for i in range(blocks):
        part = held.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i) if blocks > 1 else held
        found = _ends(texts.sparkSession, part, least, most)(F.col(text))
        out = out.withColumn("best" if not i else "_next", found)
        out = out.withColumn("best", greater(F.col("best"), F.col("_next"))).drop("_next") if i else out
    out = out.select(*key, "best").where(F.col("best").isNotNull())
    if one_row:
        return out
    all_of = F.collect_list("best")
    return out.groupBy(*key).agg(F.reduce(all_of, F.array().cast("array<array<bigint>>"), greater).alias("best"))


def _ends(spark, part: DataFrame, least: int, most: int):
    table: dict[str, list[int]] = {}
    for r in part.collect():
        table[r["word"]] = max(table.get(r["word"], r["score"]), r["score"])
    words = spark.sparkContext.broadcast(table)

    def ends(texts: pa.Array) -> pa.Array:
        known = words.value
        longest = min(most, max(map(len, known), default=1) - 1)
        # No word reaches beyond a stretch of characters that words have; stretches come again and again.
        stretch = re.compile("[" + re.escape("".join(set().union(*known))) + "]+") if known else None
        seen: dict[str, list] = {}

        def best(s: str) -> list:
            found = ([known[w] for k in range(least, min(i, longest) + 1) if (w := s[i - k : i + 1]) in known] for i in range(len(s)))
            return [max(x) if x else None for x in found]

        def one(t: str) -> list:
            out: list = [None] * len(t)
            for m in stretch.finditer(t) if stretch else ():
                s = m.group()
                if s not in seen:
                    seen[s] = best(s)
                out[m.start() : m.end()] = seen[s]
            return out

        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.list_(pa.list_(pa.int64())))

    return arrow_function(ends, "array<array<bigint>>")
