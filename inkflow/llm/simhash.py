"""SimHash near-duplicates by a Gray-order hierarchical index.

Two fingerprints that differ in ``most`` bits agree in one of ``most`` + 1 blocks of bits. So the index is kept once for
each block, on fingerprints that are turned until that block leads: sorted by their rank in the Gray code, so that
neighbours differ in few bits, and cut into shards where the leading block changes. All partners that a table has to
find then lie in one shard, and a fingerprint is sent to as many shards as there are blocks, however many shards there are.

In a shard a tree keeps, in every upper node, the bits that all fingerprints below it share (a mask and a pattern). A
query adds up its differences on those bits on the way down, counting each bit once, and leaves a whole group as
soon as the sum exceeds the limit. Copies share one fingerprint and enter the index once. A task folds its links
into least-node stars before it returns them, so its output grows with the fingerprints and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import BROADCAST_KEYS, components, cut, small_batches, table, text_hash

#: Fingerprints that a shard of the index aims to hold, shards of a table at most, fingerprints of one task, the fan-out of the trees.
SHARD, SHARDS, HELD, FAN = 32_768, 65_536, 131_072, 16
#: Leading bits by which the borders of shards are found.
CELL = 16
#: Pairs of query and node that are expanded at once.
FRONTIER = 1 << 17


def shingle_hashes(text: str | None, width: int, seed: int = 42):
    """Arrays of XXH64 of the shingles of ``width`` words, repeats included, a stretch at a time; fewer words: one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined, width, digest = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1 :].tolist()
    for k in range(0, n, 65_536):
        yield np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[k : k + 65_536], ends[k : k + 65_536])], np.uint64)


def majority(hashes) -> int:
    """The bits that are set in over half of all hashes of the arrays; none: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over the shingles of ``width`` words; no words: 0; fewer than ``width``: one shingle."""
    return majority(shingle_hashes(text, width, seed))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order of the reflected Gray code."""
    r = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


class GrayTree:
    """Tree over entries in Gray order; an entry has a mask of bits that are fixed in it, and their pattern."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray, fan: int = FAN):
        self.fan, levels = fan, [(patterns, masks)]
        while len(levels[-1][0]) > fan:
            p, m = levels[-1]
            at = np.arange(0, len(p), fan)
            shared = np.bitwise_and.reduceat(m, at) & ~(np.bitwise_or.reduceat(p, at) ^ np.bitwise_and.reduceat(p | ~m, at))
            levels.append((p[at] & shared, shared))
        self.levels = []
        for k, (p, m) in enumerate(levels):
            above = np.repeat(levels[k + 1][1], fan)[: len(p)] if k + 1 < len(levels) else np.zeros_like(m)
            self.levels.append((p, m & ~above))  # only the bits that the nodes above have not counted

    def search(self, queries: np.ndarray, most: int):
        """Yields (query, entry) index arrays of all entries within ``most`` differing fixed bits."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        for k in range(0, len(queries), max(1, FRONTIER // max(n, 1))):
            q = np.arange(k, min(len(queries), k + max(1, FRONTIER // max(n, 1))))
            yield from self._down(queries, top, np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, np.uint8), most)

    def _down(self, queries, level, q, node, seen, most):
        p, m = self.levels[level]
        seen = seen + np.bitwise_count((queries[q] ^ p[node]) & m[node])
        near = seen <= most
        q, node, seen = q[near], node[near], seen[near]
        if not level:
            if len(q):
                yield q, node
            return
        below = len(self.levels[level - 1][0])
        for k in range(0, len(q), FRONTIER // self.fan):
            part = slice(k, k + FRONTIER // self.fan)
            child = (node[part, None] * self.fan + np.arange(self.fan)).ravel()
            real = child < below
            yield from self._down(queries, level - 1, np.repeat(q[part], self.fan)[real], child[real], np.repeat(seen[part], self.fan)[real], most)


def stars(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Folds the links a-b (indices) into ``root``, where each index holds a lesser one of its component."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every whole text as a signed 64-bit integer; null and blank texts give 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    d = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _rank(column: Column, bits: int) -> Column:
    """Place of the ``bits`` low bits in the Gray order, in DataFrame operations."""
    k = 1
    while k < bits:
        column = column.bitwiseXOR(F.shiftright(column, k))
        k *= 2
    return column


def tables(codes: DataFrame, most: int) -> DataFrame:
    """(place, lead, fp) of ``codes(fp)`` in each of the ``most`` + 1 tables: the Gray rank of the block that leads there."""
    at = [64 * k // (most + 1) for k in range(most + 2)]
    block = lambda k: F.shiftrightunsigned("fp", 64 - at[k + 1]).cast("long").bitwiseAND((1 << at[k + 1] - at[k]) - 1)
    each = [F.struct(F.lit(k).alias("place"), _rank(block(k), at[k + 1] - at[k]).alias("lead")) for k in range(most + 1)]
    return codes.select("fp", F.explode(F.array(*each)).alias("t")).select("t.place", "t.lead", "fp")


def borders(rows: DataFrame, most: int, size: float) -> dict[int, np.ndarray]:
    """The last lead of each shard of ``tables`` rows, for each table, shards holding about ``size`` rows.

    Leads are counted by their first CELL bits, so what is shuffled and collected is bounded, whatever the rows.
    """
    at = [64 * k // (most + 1) for k in range(most + 2)]
    low = [max(0, at[k + 1] - at[k] - CELL) for k in range(most + 1)]
    cell = F.floor(F.col("lead") / F.element_at(F.array(*[F.lit(1 << x).cast("long") for x in low]), F.col("place") + 1)).cast("long")
    counts = rows.groupBy("place", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    place, cells, n = (counts.column(c).to_numpy() for c in ("place", "cell", "n"))
    out = {}
    for k in np.unique(place):
        own = np.flatnonzero(place == k)
        own = own[np.argsort(cells[own])]
        upto = np.cumsum(n[own])
        last = np.flatnonzero(np.diff(np.floor(upto / size), append=-1) != 0)[:-1]  # a shard ends with the cell in which it is full
        out[int(k)] = (cells[own][last] + 1 << low[k]) - 1
    return out


def links(codes: DataFrame, most: int = 2, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """Edges (a, b) that connect all distinct ``codes(fp)`` with ``most`` or fewer differing bits, as stars."""
    spark = codes.sparkSession
    n = codes.count()
    shards = max(1, min(SHARDS, -(-n // shard)))
    rows = tables(codes, most)
    if shards > 1:
        # A shard ends where the leading block does, so fingerprints that agree in it stay together.
        sent = spark.sparkContext.broadcast(borders(rows, most, n / shards))
    else:
        sent = spark.sparkContext.broadcast({})

    def sharded(batches):
        for b in batches:
            place, lead = b.column(0).to_numpy(), b.column(1).to_numpy()
            s = np.zeros(len(place), np.int32)
            for k, v in sent.value.items():
                s[place == k] = np.searchsorted(v, lead[place == k], side="left")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), b.column(2)], ["place", "shard", "fp"])

    rows = rows.mapInArrow(sharded, "place int, shard int, fp long")
    # A shard that holds more than one task should is cut into blocks that meet pair by pair.
    blocks = rows.groupBy("place", "shard").agg(F.ceil(F.count(F.lit(1)) / held).alias("blocks")).where("blocks > 1")
    blocks = cut(blocks)
    if not blocks.isEmpty():
        rows = rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_KEYS else blocks, ["place", "shard"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.select("place", "shard", F.least("own", "other").alias("asks"), F.greatest("own", "other").alias("holds"), "fp", "own")
    else:
        rows = rows.select("*", F.lit(0).cast("long").alias("asks"), F.lit(0).cast("long").alias("holds"), F.lit(0).cast("long").alias("own"))

    def local(key, t):
        at = [64 * k // (most + 1) for k in range(most + 1)]
        turn = at[key[0].as_py()]
        fp, own = t.column("fp").to_numpy().view(np.uint64), t.column("own").to_numpy()
        turned = fp << np.uint64(turn) | fp >> np.uint64(64 - turn) if turn else fp
        order = np.argsort(gray_rank(turned))
        fp, turned, own = fp[order], turned[order], own[order]
        asks, holds = key[2].as_py(), key[3].as_py()
        m, q = np.flatnonzero(own == holds), np.flatnonzero(own == asks)
        root = np.arange(len(fp))
        if len(m):
            for a, e in GrayTree(turned[m], np.full(len(m), ~np.uint64(0))).search(turned[q], most):
                a, e = q[a], m[e]
                apart = a < e if asks == holds else a != e
                stars(a[apart], e[apart], root)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    return rows.groupBy("place", "shard", "asks", "holds").applyInArrow(local, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, most: int = 2, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component, component_id.

    Documents whose fingerprints differ in ``most`` or fewer bits are linked; component names what links reach, and
    component_id is the least doc_id there (null only where none is known). Null, empty and blank texts have
    fingerprint 0 and link like any other; texts of any length are read whole. Repeated rows come back as often as
    they are there, rows that share a doc_id each with their own text's group; columns other than doc_id and
    text are not read; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, width))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), most, shard)).toDF("fp", "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", F.col("root").alias("component"), "component_id"), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, groups=simhash_groups) -> DataFrame:
    """One document of each group, with its own columns: that of the least doc_id (null last), then the least text hash.

    ``groups`` finds (doc_id, text_hash, component) of every row. A row is known by its doc_id and text, so unlike texts that share a
    doc_id, or have none, are documents of their own. Of rows alike in both, the one of the least hash of all columns
    stays. Null and empty texts form a group like any other. An empty table gives an empty result.
    """
    found = groups(docs)
    keys = found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    keys = cut(keys.join(first, "component").select("doc_id", "text_hash", "n", stays.alias("stays")))
    named = lambda k: k.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    gone, repeated = named(keys.where("not stays")), named(keys.where("stays and n > 1"))
    again = not repeated.isEmpty()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text_hash(F.col("text")).alias("_text"))
    same = lambda k: d["_doc"]["doc_id"].eqNullSafe(k["_id"]) & (d["_text"] == k["_hash"])
    small = lambda k: F.broadcast(k) if k.count() <= BROADCAST_KEYS else k
    off = small(gone.union(repeated) if again else gone)
    kept = d.join(off, same(off), "left_anti")
    if again:
        some = small(repeated)
        one = d.join(some, same(some), "left_semi").groupBy(F.col("_doc.doc_id").alias("_id"), "_text").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
        kept = kept.select("_doc").union(one.select("_doc"))
    return kept.select("_doc.*")
