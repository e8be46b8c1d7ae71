"""Global token positions and windows by count, without a global sort of tokens.

Documents are the unit: each knows its ids and where it starts. Positions come from a prefix sum over order keys alone, whose
ranges have their borders from the data, so that no task ever sees all documents. Windows are put together from the
slices that documents lend them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.plans.lineage import cut

BLOCK = STRIDE = 256
#: Rows of a key and a number that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def _before(by: tuple[str, ...], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _same(d: DataFrame, other: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equal keys, null like null; ``other`` has them with a mark before the name."""
    return reduce(Column.__and__, [d[k].eqNullSafe(other[f"_k_{k}"]) for k in keys])


def _marked(d: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    return d.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *more)


def key_ranges(df: DataFrame, keys: tuple[str, ...], value: Column) -> DataFrame:
    """(keys, _sum, _n, _part): sums and rows of each key, dealt to ranges of keys that are cut where the data say so.

    Nothing but keys and numbers is shuffled. Ranges hold about equally many keys, whether these are dense, sparse, hashes or far apart, and
    there are more of them with more keys: as many as shuffle partitions, fewer where Spark joins small ones.
    """
    sums = df.select(*keys, value.cast("long").alias("_value")).groupBy(*keys).agg(F.sum("_value").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return cut(sums.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def prefix_sum(df: DataFrame, order: str, value: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, by the column ``order``, for each ``by``.

    Keys are summed up in ranges (``key_ranges``); one sum for each range and ``by`` meets in one task, and the sum before each key is joined
    back to the rows, which move once, or not at all while the keys are few enough to be broadcast. Rows without a key come first.
    Rows of one key follow each other by a hash of the whole row, in ranges of that hash; only rows alike in all columns meet in one task.
    """
    return _summed(df, order, value, name, by, False)


def _summed(df: DataFrame, order: str, value: Column, name: str, by: tuple[str, ...], alike: bool) -> DataFrame:
    keys = (*by, order)
    ranges = key_ranges(df, keys, value)
    held, most = ranges.agg(F.count(F.lit(1)), F.max("_n")).first()
    totals = ranges.groupBy(*by, "_part").agg(F.sum("_sum").alias("_total"))
    base = _marked(totals.withColumn("_base", F.coalesce(F.sum("_total").over(_before(by, "_part")), F.lit(0))), (*by, "_part"), "_base")
    inside = F.coalesce(F.sum("_sum").over(_before((*by, "_part"), order)), F.lit(0))
    placed = ranges.withColumn("_inside", inside).join(base, _same(ranges, base, (*by, "_part")))
    starts = _marked(placed.withColumn("_start", F.col("_base") + F.col("_inside")), keys, "_start", "_n")
    starts = F.broadcast(starts) if held <= BROADCAST_KEYS else starts.hint("shuffle_hash")
    out = df.join(starts, _same(df, starts, keys))
    own = [F.col(f"`{c}`") for c in df.columns]
    if (most or 0) < 2:
        return out.select(*own, F.col("_start").alias(name))
    more = out.where("_n > 1").select(*own, F.col("_start").alias(f"_to_{name}"))
    if alike:
        more = more.withColumn("_after", F.coalesce(F.sum(value.cast("long")).over(_before(keys, order)), F.lit(0)))
    else:
        tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
        more = _summed(more.withColumn("_tie", tie), "_tie", value, "_after", keys, True)
    more = more.select(*own, (F.col(f"_to_{name}") + F.col("_after")).alias(name))
    return out.where("_n = 1").select(*own, F.col("_start").alias(name)).union(more)


def windows(docs: DataFrame, block: int = BLOCK, stride: int = STRIDE, by: tuple[str, ...] = (), total: Column | None = None) -> DataFrame:
    """``docs(start, ids, ..by)`` -> (..by, window_id, x, target): every full window of ``block`` ids and their successors.

    Windows start at multiples of ``stride`` and cross documents; one is there if the id after it is. ``total`` is
    the number of ids; it may be left out if a window that is cut short is to be found by its length.
    """
    if stride > block:
        raise ValueError("a stride above the block would lose what lies between windows")
    size, end = F.size("ids"), F.col("start") + F.size("ids") - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - block) / stride))
    last = F.floor(end / stride)
    if total is not None:
        last = F.least(last, F.floor((total - block - 1) / stride))
    first, last = first.cast("long"), last.cast("long")

    # Windows inside one document are cut out of it as they are, right where their numbers are listed, so none carries a whole document along.
    inner, outer = F.greatest(first, F.ceil(F.col("start") / stride).cast("long")), F.least(last, F.floor((end - block) / stride).cast("long"))
    own = docs.select(*by, "start", "ids", F.explode(F.when(inner <= outer, F.sequence(inner, F.greatest(inner, outer)))).alias("window_id"))
    at = (F.col("window_id") * stride - F.col("start") + 1).cast("int")
    own = own.select(*by, "window_id", F.slice("ids", at, block).alias("x"), F.slice("ids", at + 1, block).alias("target"))

    def piece(k):
        low, high = F.greatest(k * stride, F.col("start")), F.least(k * stride + block + 1, F.col("start") + size)
        return F.struct(k.alias("window_id"), low.alias("low"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("part"))

    # Only those that cross documents are put together, from a block at most at each end.
    crossing = F.filter(F.when(first <= last, F.sequence(first, F.greatest(first, last))), lambda k: (k < inner) | (k > outer))
    pieces = docs.select(*by, F.explode(F.transform(crossing, piece)).alias("w")).select(*by, "w.*")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda p: p["part"]))
    w = pieces.groupBy(*by, "window_id").agg(whole.alias("ids")).where(F.size("ids") == block + 1)
    return own.union(w.select(*by, "window_id", F.slice("ids", 1, block).alias("x"), F.slice("ids", 2, block).alias("target")))


def window_count(rows: Column, block: int = BLOCK, stride: int = STRIDE) -> Column:
    return F.greatest(F.lit(0), F.floor((rows - block - 1) / stride) + 1).cast("long")


def sharded(docs: DataFrame, rows_per_shard: int) -> DataFrame:
    """``docs(start, ids)`` cut at shard borders: (shard_id, start in the shard, ids)."""
    end = F.col("start") + F.size("ids") - 1
    d = docs.where(F.size("ids") > 0).select("start", "ids", F.explode(F.sequence(F.floor(F.col("start") / rows_per_shard), F.floor(end / rows_per_shard))).alias("shard_id"))
    low = F.greatest(F.col("shard_id") * rows_per_shard, F.col("start"))
    high = F.least((F.col("shard_id") + 1) * rows_per_shard, F.col("start") + F.size("ids"))
    return d.select("shard_id", (low - F.col("shard_id") * rows_per_shard).alias("start"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def manifest(docs: DataFrame, rows_per_shard: int, block: int = BLOCK, stride: int = STRIDE, size: Column | None = None) -> DataFrame:
    """(shard_id, rows, windows, first_window): windows never cross shards. With ``size``, a column of lengths, the ids need not be there."""
    d = docs.select("start", (F.size("ids") if size is None else size).cast("long").alias("_n")).where("_n > 0")
    shard = F.explode(F.sequence(F.floor(F.col("start") / rows_per_shard), F.floor((F.col("start") + F.col("_n") - 1) / rows_per_shard)))
    d = d.select("start", "_n", shard.alias("shard_id"))
    rows = F.least((F.col("shard_id") + 1) * rows_per_shard, F.col("start") + F.col("_n")) - F.greatest(F.col("shard_id") * rows_per_shard, F.col("start"))
    m = d.groupBy("shard_id").agg(F.sum(rows).cast("long").alias("rows"))
    m = m.withColumn("windows", window_count(F.col("rows"), block, stride))
    return prefix_sum(m, "shard_id", F.col("windows"), "first_window")


def locate(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """``asked(window_index)`` -> (window_index, shard_id, local_index) by the ranges of ``shards(shard_id, windows, first_window)``.

    Shards hold about equally many windows, so ranges are met through equal buckets instead of a nested loop.
    """
    width = 1024
    s = shards.where("windows > 0").select("shard_id", "windows", "first_window", F.explode(F.sequence(F.floor(F.col("first_window") / width), F.floor((F.col("first_window") + F.col("windows") - 1) / width))).alias("_bucket"))
    a = asked.withColumn("_bucket", F.floor(F.col("window_index") / width))
    hit = a.join(s, "_bucket").where("window_index >= first_window and window_index < first_window + windows")
    return hit.select("window_index", "shard_id", (F.col("window_index") - F.col("first_window")).alias("local_index"))


def validation_windows(n: int, least: int = 128, share: float = 0.002, most: int = 1024) -> int:
    """Windows of the tail that are held out: a share, within bounds; none if there are not more than that."""
    held = min(max(least, int(n * share)), most)
    return held if n > held else 0


def validation_shards(n: int, most: int = 4) -> int:
    return min(most, n - 1)
