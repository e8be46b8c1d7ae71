"""A seeded permutation of the numbers below n that needs no sort: each number knows its place, and each place its number.

Numbers are written as pairs of a rectangle of little more than n cells; rounds add a hash of one coordinate to the other, which can be undone
whatever the hash. A number that lands outside n goes on until it is inside; it meets only cells outside on the way, so their number bounds it.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
#: Sides that are tried for the rectangle with the fewest cells beyond n.
TRIED = 4096


def rectangle(n: int) -> tuple[int, int]:
    """Sides (a, b) with a * b >= n; of TRIED sides from the root on the one with the fewest cells beyond, then the least."""
    first = max(1, isqrt(n))
    return min(((a, -(-n // a)) for a in range(first, first + TRIED)), key=lambda s: (s[0] * s[1], s[0]))


def _hash(seed: int, i: Column, x: Column) -> Column:
    """32 bits of md5, which SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), x.cast("string"))), 1, 8), 16, 10).cast("long")


def _walk(x: Column, n: int, seed: int, back: bool) -> Column:
    a, b = rectangle(n)
    sign = -1 if back else 1

    def one(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + sign * _hash(seed, i, s["r"]), F.lit(a).cast("long"))
        right = F.pmod(s["r"] + sign * _hash(seed, i, s["l"]), F.lit(b).cast("long"))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    rounds = F.array(*map(F.lit, order))

    def through(v: Column) -> Column:
        pair = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b).cast("long")).alias("r"))
        return F.aggregate(rounds, pair, one, lambda s: s["l"] * b + s["r"])

    most = F.sequence(F.lit(0), F.lit(a * b - n))
    return F.aggregate(most, x.cast("long"), lambda v, k: F.when((k == 0) | (v >= n), through(v)).otherwise(v))


def number_at(place: Column, n: int, seed: int = 67) -> Column:
    """The number below ``n`` that comes at ``place``."""
    return _walk(place, n, seed, False)


def place_of(number: Column, n: int, seed: int = 67) -> Column:
    """The place at which ``number`` comes."""
    return _walk(number, n, seed, True)


def shuffled_minibatches(windows: DataFrame, n: int, size: int = 128, seed: int = 67, epoch: int = 0) -> DataFrame:
    """Adds batch_id and row to ``windows(window_id, ..)``, ``n`` in all, in an order of seed and epoch; none is dropped, and nothing is sorted or shuffled."""
    if not n:
        return windows.withColumns({"batch_id": F.lit(0).cast("long"), "row": F.lit(0).cast("long")})
    return windows.withColumn("_place", place_of(F.col("window_id"), n, seed + epoch)).withColumns({"batch_id": F.floor(F.col("_place") / size), "row": F.pmod("_place", F.lit(size))}).drop("_place")


def batch_windows(spark: SparkSession, batch_id: int, n: int, size: int = 128, seed: int = 67, epoch: int = 0) -> DataFrame:
    """(row, window_id) of one batch alone, to read its windows without a look at the others."""
    low = batch_id * size
    return spark.range(low, max(low, min(n, low + size))).select((F.col("id") - low).alias("row"), number_at(F.col("id"), n, seed + epoch).alias("window_id"))
