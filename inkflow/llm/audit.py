"""Filter interaction audit: what each filter removes in every order, from counts of failure masks.

A document fails a set of filters, its mask. Per part the counts of the masks give a removal polynomial, one variable
for each filter: at a corner of the cube it is what the chosen filters remove together, so corners supply survivors,
removals and losses of every prefix of every order. A filter's Shapley value is the integral of the polynomial's partial
derivative along the diagonal, in exact rationals; times 120 it is the sum of its removals over all orders.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import cut, table
from inkflow.llm.secrets import once

FILTERS = "ABCDE"
#: Limits of the filters: words at least, percent of distinct words at least, percent of capitals at most, marks that none may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
#: Parts that documents without an id are spread over in the join with labels.
SALTS = 64
COUNTED = ("n", "good", "toxic")


def removal_polynomial(counts: list[int], filters: int) -> list[int]:
    """Coefficients of the multilinear polynomial, by the set of variables: what filters remove of ``counts`` (by mask).

    A document of a mask is removed unless every filter in it is off: 1 - product of (1 - x). Its term of a set within
    the mask is 1, with the sign of the set's size.
    """
    held = list(counts)
    for i in range(filters):  # sums over all masks that include a set
        for s in range(1 << filters):
            if not s >> i & 1:
                held[s] += held[s | 1 << i]
    return [0] + [c if s.bit_count() % 2 else -c for s, c in enumerate(held[1:], 1)]


def corners(polynomial: list[int], filters: int) -> list[int]:
    """The polynomial's value where the variables of each set are 1 and all others 0."""
    out = list(polynomial)
    for i in range(filters):
        for s in range(1 << filters):
            if s >> i & 1:
                out[s] += out[s ^ 1 << i]
    return out


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by variable ``i``, all variables equal."""
    return sum((Fraction(c, s.bit_count()) for s, c in enumerate(polynomial) if s >> i & 1), Fraction(0))


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    short_or_plain = once(words, lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), 2).otherwise(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return short_or_plain + F.when(100 * capitals > MOST_CAPITALS * F.length(text), 4).otherwise(0) + F.when(F.rlike(text, F.lit(MARKS)), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source (null: empty) by the set of filters they fail.

    Only ids, digests and masks are shuffled. Copies of a text are counted for each source before they meet the text's
    least id, and rows that hold this id are taken back out, so no key of a join holds a group of copies. Texts are told apart by
    their SHA-256. A document without an id has no smaller one; a text that stands twice under the least id passes E both times.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text")).alias("own"))
    rows = read.groupBy("digest", "doc_id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(0)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("good or toxic").withColumn("salt", F.lit(0))
    one = lambda c: F.when(F.col(c), F.col("n")).otherwise(0).cast("long").alias(c)
    rows = rows.join(marks, ["doc_id", "salt"], "left").select("digest", "doc_id", "part", "own", "n", one("good"), one("toxic"))

    sums = [F.sum(c).alias(c) for c in COUNTED]
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    counted = rows.groupBy("digest", "part", "own").agg(*sums).join(copies.select("digest", F.lit(1 << 4).alias("e")), "digest", "left")
    failing = counted.select("part", (F.col("own") + F.coalesce("e", F.lit(0))).alias("mask"), *COUNTED)
    firsts = rows.join(copies.select("digest", F.col("first").alias("doc_id")), ["digest", "doc_id"])
    unnumbered = rows.where("doc_id is null").groupBy("digest", "part", "own").agg(*sums).join(copies, "digest", "left_semi")
    passing = firsts.select("part", "own", *COUNTED).union(unnumbered.select("part", "own", *COUNTED))
    taken_back = passing.select("part", F.explode(F.array(F.struct((F.col("own") + (1 << 4)).alias("mask"), F.lit(-1).alias("sign")), F.struct(F.col("own").alias("mask"), F.lit(1).alias("sign")))).alias("m"), *COUNTED)
    taken_back = taken_back.select("part", "m.mask", *[(F.col("m.sign") * F.col(c)).alias(c) for c in COUNTED])
    return failing.union(taken_back).groupBy("part", "mask").agg(*sums)


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts) for all orders of the filters, from ``masks(part, mask, n, good, toxic)``; bit i is the i-th filter.

    A part has one row of counts for each mask at most, whatever it holds. No masks give no rows.
    """
    k = len(filters)
    by_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("masks"))
    orders = [("".join(p), step, sum(1 << filters.index(c) for c in p[: step - 1]), filters.index(p[step - 1])) for p in permutations(filters) for step in range(1, k + 1)]
    every = (1 << k) - 1
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for b in batches:
            for part, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = {c: [0] * (1 << k) for c in COUNTED}
                for m in held:
                    for c in COUNTED:
                        counts[c][m["mask"]] += m[c]
                polynomials = {c: removal_polynomial(counts[c], k) for c in COUNTED}
                gone, good, toxic = (corners(polynomials[c], k) for c in COUNTED)
                values = [factorial(k) * shapley(polynomials["n"], i) for i in range(k)]
                total, rows = sum(counts["n"]), []
                for _, _, before, i in orders:
                    after, bit = before | 1 << i, 1 << i
                    removed = gone[after] - gone[before]
                    rows.append((total - gone[after], removed, gone[bit] - removed, gone[every] - gone[every ^ bit], good[after] - good[before], toxic[after] - toxic[before], int(values[i])))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), pa.array([o[0] for o in orders]), pa.array([o[1] for o in orders], pa.int32()), *columns], ["part", "filter_order", "step", *names])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs(doc_id, text, source)``, one row for each part, order and step.

    Null texts are empty; texts of any length are read whole; repeated rows count each. Labels of one id are united: good or toxic
    if any row says so; those without an id fit nothing. Other columns are not read. Without documents there are no parts and no rows.
    """
    return audit(mask_counts(docs, labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order is applied step by step to the counts of masks; Shapley values are summed over the orders, without a polynomial.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step::INT AS step, any_value(bit) AS bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
