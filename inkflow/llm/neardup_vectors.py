"""Embedding near-duplicates by product quantisation.

A coarse quantiser deals the vectors to inverted lists; the residuals are coded by subspace. A query probes its
nearest lists, as many as keep nearly all pairs at the limit together on the sample that the quantisers are
fitted on. In a list, distances come from one lookup table per query and subspace; no vector is passed over whose
table distance less its own coding error is within the limit. What is left is ranked by exact cosine in double.

Equal vectors of one label form a class that is searched once. A list's task returns sums of links and
least-node stars, so its output grows with the vectors and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import components, cut, small_batches, table
from inkflow.llm.simhash import stars

#: Vectors that the quantisers are fitted on, lists at most, subspaces, codes of a subspace.
SAMPLE, LISTS, SUBSPACES, CODES = 20_000, 4096, 8, 256
#: Share of sampled pairs at the limit whose lists must be probed; members and queries of one task.
SUFFICIENT, MEMBERS, QUERIES = 0.995, 8192, 16_384


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, y: np.ndarray, rows: int = 512) -> np.ndarray:
    """The nearest of ``y`` to each of ``x``, some rows at a time, so that no whole matrix of distances is held."""
    return np.concatenate([np.zeros(0, np.int64), *(_distances(x[k : k + rows], y).argmin(axis=1) for k in range(0, len(x), rows))])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


class Quantiser:
    """Coarse lists, residual codes and the number of probes, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, limit: float, seed: int = 67):
        rng = np.random.default_rng(seed)
        self.centers = kmeans(sample, lists, rng)
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        residual = sample - self.centers[nearest(sample, self.centers)]
        self.books = [kmeans(residual[:, p], CODES, rng) for p in self.parts]
        some = sample[:2000]
        side = rng.standard_normal(some.shape)
        side -= (side * some).sum(axis=1, keepdims=True) * some
        moved = limit * some + np.sqrt(1 - limit * limit) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        d = _distances(some, self.centers)
        home = nearest(moved, self.centers)
        rank = (d < d[np.arange(len(d)), home][:, None]).sum(axis=1)
        self.probes = int(np.quantile(rank, SUFFICIENT, method="higher")) + 1

    def code(self, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance between each vector and what its codes stand for."""
        residual, error = v - self.centers[own], np.zeros(len(v))
        codes = np.zeros((len(v), len(self.parts)), np.uint8)
        for j, (p, book) in enumerate(zip(self.parts, self.books)):
            d = _distances(residual[:, p], book)
            codes[:, j] = d.argmin(axis=1)
            error += d[np.arange(len(v)), codes[:, j]]
        return codes, np.sqrt(error)

    def near(self, v: np.ndarray) -> np.ndarray:
        """The lists to probe, nearest first; the first is the vector's own."""
        each = [np.argsort(_distances(v[k : k + 512], self.centers), axis=1, kind="stable")[:, : self.probes] for k in range(0, len(v), 512)]
        return np.concatenate([np.zeros((0, self.probes), np.int64), *each])

    def search(self, queries: np.ndarray, at: int, members: np.ndarray, codes: np.ndarray, error: np.ndarray, limit: float, rows: int = 256):
        """Yields (query, member) index arrays with cosine >= ``limit`` among the members of list ``at``."""
        reach = np.sqrt(2 - 2 * limit) + error + 1e-6
        for k in range(0, len(queries), rows):
            q = queries[k : k + rows]
            r = q - self.centers[at]
            d = np.zeros((len(q), len(members)), np.float32)
            for j, (p, book) in enumerate(zip(self.parts, self.books)):
                d += _distances(r[:, p], book).astype(np.float32)[:, codes[:, j]]
            a, b = np.nonzero(np.sqrt(d) <= reach)
            for s in range(0, len(a), 1 << 17):
                x, y = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
                real = np.einsum("ij,ij->i", q[x], members[y]) >= limit
                yield x[real] + k, y[real]


def classes_of(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector and label: cid, label, embedding, n, first (its least vec_id)."""
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    c = vectors.where(F.coalesce(usable, F.lit(False))).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    return cut(cut(c).withColumn("cid", F.monotonically_increasing_id()))


def _searcher(sent, dim: int, limit: float):
    """The search of one block of queries in one block of a list's members."""

    def local(key, t):
        quantiser, at = sent.value, key[1].as_py()
        held = t.column("held").to_numpy()
        cid, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
        v = unit(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        near = t.column("near").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        m, q = np.flatnonzero(held), np.flatnonzero(~held)
        if not len(m) or not len(q):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        codes, error = quantiser.code(v[m], np.full(len(m), at))
        nodes = np.unique(cid)
        root, total = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        place = np.searchsorted(nodes, cid)
        for x, y in quantiser.search(v[q], at, v[m], codes, error, limit):
            x, y = q[x], m[y]
            other = cid[x] != cid[y]
            x, y = x[other], y[other]
            np.add.at(total, place[x], n[y])
            # The member finds this query itself only if it probes the query's own list.
            blind = ~(near[y] == near[x, 0][:, None]).any(axis=1)
            np.add.at(total, place[y[blind]], n[x[blind]])
            stars(place[x], place[y], root)
        told = np.flatnonzero((total > 0) | (root != np.arange(len(nodes))))
        return pa.table({"a": nodes[told], "b": nodes[root[told]], "n": total[told]})

    return local


def links(classes: DataFrame, limit: float, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((cid, n): vectors of other classes that are linked, (a, b): stars of linked classes)."""
    spark = classes.sparkSession
    n = classes.count()
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("more than 1000 lengths of vectors")
    counted, starred = [], []
    for dim in dims:
        own = classes.where(F.size("embedding") == dim)
        sample = own.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
        sample = unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        quantiser = Quantiser(sample, int(max(1, min(LISTS, round((n / 64) ** 0.5)))), limit)
        quantiser.probes = probes or quantiser.probes
        sent = spark.sparkContext.broadcast(quantiser)
        small_batches(spark)

        def routed(batches, sent=sent, dim=dim):
            for b in batches:
                v = unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) if b.num_rows else np.zeros((0, dim))
                if not b.num_rows:
                    continue
                near = sent.value.near(v)
                width = near.shape[1]
                row = np.repeat(np.arange(len(v)), width)
                take = lambda c: c.take(pa.array(row))
                member = np.tile(np.arange(width) == 0, len(v))
                yield pa.RecordBatch.from_arrays([take(b.column(0)), take(b.column(1)), take(b.column(2)), take(b.column(3)), pa.array(near.ravel()), pa.array(near.tolist(), pa.list_(pa.int64())).take(pa.array(row)), pa.array(member)], ["cid", "label", "embedding", "n", "list", "near", "member"])

        kind = own.select("cid", "label", "embedding", "n")
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.schema)
        rows = cut(kind.mapInArrow(routed, f"{types}, list long, near array<long>, member boolean"))
        size = rows.groupBy("label", "list").agg(F.ceil(F.count(F.when(F.col("member"), 1)) / MEMBERS).alias("m"), F.ceil(F.count(F.lit(1)) / QUERIES).alias("q")).where("m > 0")
        dealt = rows.join(size, ["label", "list"])
        h = F.xxhash64("cid")
        every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        asks = dealt.select("*", F.pmod(h, F.col("q")).alias("qb"), F.explode(every("m")).alias("mb")).withColumn("held", F.lit(False))
        holds = dealt.where("member").select("*", F.explode(every("q")).alias("qb"), F.pmod(h, F.col("m")).alias("mb")).withColumn("held", F.lit(True))
        blocks = asks.unionByName(holds)

        found = cut(blocks.groupBy("label", "list", "qb", "mb").applyInArrow(_searcher(sent, dim, limit), "a long, b long, n long"))
        counted.append(found.select(F.col("a").alias("cid"), "n"))
        starred.append(found.select("a", "b"))
    if not dims:
        return classes.select("cid", F.col("n").alias("n_others")), classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    total, edges = counted[0], starred[0]
    for c, s in zip(counted[1:], starred[1:]):
        total, edges = total.union(c), edges.union(s)
    return total.groupBy("cid").agg(F.sum("n").alias("n_others")), edges


def vector_groups(vectors: DataFrame, limit: float = 0.93) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors of one label (and length) whose cosine, in double precision, is at least ``limit`` are linked; n_links counts the
    other rows that are linked directly, equal ones included. component_id is the least vec_id that links reach.
    A null label, and a vector that is null, empty, zero or holds a null or non-finite component, links with
    nothing. Rows that repeat are linked with one another. Other columns are not read; an empty table gives an
    empty result.
    """
    v = vectors.select("vec_id", "embedding", "label")
    classes = classes_of(v)
    others, edges = links(classes, limit)
    roots = components(edges).toDF("cid", "root")
    c = classes.join(others, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = c.groupBy("root").agg(F.min("first").alias("component_id"))
    c = c.join(least, "root").select("label", "embedding", (F.col("n") - 1 + F.coalesce("n_others", F.lit(0))).alias("n_links"), "component_id")
    out = v.join(c, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and what they reach.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS kept FROM embeddings
"""
