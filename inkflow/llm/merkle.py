"""Merkle manifest of a dataset: a tree of arity 8 for each language, a tree of their roots, and a proof for every document.

Leaves are numbered in order by a range sort and dealt in aligned blocks of 8^4. A treehash stack turns a block into
its root, and roots are blocks of the level above, until a language has one. Downwards each block is walked leaf by
leaf: for every level a treehash is one run ahead of the leaf, so its authentication path is there with a memory that
grows with the levels, not with the leaves; the path above is the same for the whole block and is appended.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm.common import BROADCAST_KEYS, cut, table

#: Nodes of a run that become one, and levels of a block.
ARITY, HEIGHT = 8, 4
BLOCK = ARITY**HEIGHT
#: Documents whose crc32 this divides are the tampered ones.
TAMPERED = 3
_NODE = "tree string, pos long, total long, digest binary"
_PATH = "tree string, pos long, path array<struct<at:int,left:string,right:string>>, subroot string, root string"


def joined(nodes: Sequence[str]) -> str:
    """The digest of consecutive nodes, all as hexadecimal text."""
    return sha256("".join(nodes).encode()).hexdigest()


def depth(leaves: int) -> int:
    """Levels above so many leaves until one node is left."""
    d = 0
    while ARITY**d < leaves:
        d += 1
    return d


class TreeHash:
    """The runs of nodes of one level, in order, made leaf by leaf with one unfinished run for each level below."""

    def __init__(self, leaves: Sequence[str], level: int):
        self.leaves, self.level, self.at = leaves, level, 0
        self.open: list[list[str]] = [[] for _ in range(level + 1)]
        self.run: list[str] = []

    def advance(self) -> None:
        """Takes in one more leaf, if there is one; after the last one unfinished runs are closed."""
        if self.at < len(self.leaves):
            self._add(0, self.leaves[self.at])
            self.at += 1
            if self.at == len(self.leaves):
                for k in range(self.level):
                    if self.open[k]:
                        run, self.open[k] = self.open[k], []
                        self._add(k + 1, joined(run))
                self.run = self.open[self.level] or self.run

    def _add(self, level: int, node: str) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            run, self.open[level] = self.open[level], []
            if level == self.level:
                self.run = run
            else:
                self._add(level + 1, joined(run))


def block_root(leaves: Sequence[str], height: int) -> str:
    t = TreeHash(leaves, height)
    for _ in leaves:
        t.advance()
    return t.run[0]


def traversal(leaves: Sequence[str], height: int) -> Iterator[list[list[str]]]:
    """For each leaf the runs that it and its ancestors stand in, from the leaves up to below the root.

    While the walk is inside one run of a level, that level's treehash works through the leaves of the next run, one leaf a step.
    """
    ahead = [TreeHash(leaves, k) for k in range(height)]
    runs: list[list[str]] = []
    for k, t in enumerate(ahead):
        for _ in range(ARITY ** (k + 1)):
            t.advance()
        runs.append(t.run)
    for i in range(1, len(leaves) + 1):
        yield runs
        for k, t in enumerate(ahead):
            t.advance()
            if i % ARITY ** (k + 1) == 0:
                runs[k] = t.run


def steps(runs: list[list[str]], pos: int) -> list[tuple[int, str, str]]:
    """(place in its run, siblings to the left, siblings to the right) of the node at ``pos`` and of its ancestors."""
    out = []
    for run in runs:
        at = pos % ARITY
        out.append((at, "".join(run[:at]), "".join(run[at + 1 :])))
        pos //= ARITY
    return out


def leaf_digest(text: Column) -> Column:
    """SHA-256 of a document's fields, each with its length in bytes, so that no two documents spell the same input."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(c) for c in (F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text)]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, changed): the leaf of each document, and that of the tampered one where it is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # no language comes before all others
    return docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf_digest(F.col("text"))).alias("digest"), F.when(tampered, F.unhex(leaf_digest(lowered))).alias("changed"))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds pos, from 0 in the order given within a tree, and total, the nodes of the tree.

    Rows are dealt by ranges of the key, so only the counts of ranges meet. A column of row numbers keeps rows alike in all keys apart;
    it comes from a written table and the ranges are written too, so a task that runs again gives the same numbers.
    """
    n = cut(nodes).withColumn("_row", F.monotonically_increasing_id())
    keys = ["tree", *order, "_row"]
    n = cut(n.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = n.groupBy("tree", "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("tree", "_part", (before - F.col("_low")).alias("_shift"), F.sum("_n").over(whole).alias("total")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts
    return n.join(counts, ["tree", "_part"]).select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def roots_of_blocks(nodes: DataFrame) -> DataFrame:
    """The level of roots above ``nodes(tree, pos, total, digest)``."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        total, pos = rows["total"][0].as_py(), rows["pos"][0].as_py()
        root = block_root([x.hex() for x in rows["digest"].to_pylist()], min(HEIGHT, depth(total)))
        return pa.table({"tree": [rows["tree"][0].as_py()], "pos": [pos // BLOCK], "total": [-(-total // BLOCK)], "digest": [bytes.fromhex(root)]})

    return in_blocks(nodes.select("tree", "pos", "total", "digest")).groupBy("tree", "block").applyInArrow(run, _NODE)


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, and so on until every tree has one root."""
    out = [nodes]
    while True:
        out.append(cut(roots_of_blocks(out[-1])))
        if out[-1].where("total > 1").isEmpty():
            return out


def _walk(rows: pa.Table, above: pa.Table):
    """The rows of a block in order, what is above it, and each row's steps up to the root of all."""
    rows, up = rows.sort_by("pos"), above.to_pylist()[0]
    height = min(HEIGHT, depth(rows["total"][0].as_py()))
    more = [(s["at"], s["left"], s["right"]) for s in up["path"]]
    walk = traversal([x.hex() for x in rows["digest"].to_pylist()], height)
    return rows, up, (steps(runs, i) + more for i, runs in enumerate(walk))


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The path of each node, from those of the level above; ``above(tree, pos, path, subroot, root)``."""
    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        rows, up, found = _walk(rows, up)
        made = [{"tree": up["tree"], "pos": p, "path": [dict(zip(("at", "left", "right"), s)) for s in path], "subroot": up["subroot"], "root": up["root"]} for p, path in zip(rows["pos"].to_pylist(), found)]
        path = pa.list_(pa.struct([("at", pa.int32()), ("left", pa.string()), ("right", pa.string())]))
        return pa.Table.from_pylist(made, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", path), ("subroot", pa.string()), ("root", pa.string())]))

    return in_blocks(nodes.select("tree", "pos", "total", "digest")).groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInArrow(run, _PATH)


def _down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths of the blocks of the lowest level, given those of the roots of the highest."""
    for nodes in reversed(levels[1:-1]):
        top = cut(paths(nodes, top))
    return top


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per document of ``docs(doc_id, source, lang, n_chars, text)``.

    proof_sha256 is the digest of all siblings, level by level up to the root. folded_root comes from the leaf, tampered with or not,
    and the siblings that were not. A document without an id comes first and is not tampered with; equal ids go by leaf, and rows alike
    in all have leaves, places and proofs of their own. Nulls have a spelling of their own, unlike the empty text; texts of any length are
    hashed whole. Other columns are not read. Without documents there are no trees and no rows.
    """
    placed = cut(numbered(leaves(docs), "doc_id", "digest"))
    trees = levels(placed)
    names = cut(numbered(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    forest = levels(names)
    top = forest[-1].select("tree", "pos", F.array().cast("array<struct<at:int,left:string,right:string>>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    of_names = paths(names, _down(forest, top)).drop("tree", "subroot")
    top = names.select("pos", F.col("name").alias("tree"), F.lower(F.hex("digest")).alias("subroot")).join(of_names, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        rows, up, found = _walk(rows, up)
        digests, proof, folded = [x.hex() for x in rows["digest"].to_pylist()], [], []
        for leaf, changed, path in zip(digests, rows["changed"].to_pylist(), found):
            node, siblings = changed.hex() if changed else leaf, []
            for _, left, right in path:
                siblings += left, right
                node = joined((left, node, right))
            proof.append(joined(siblings))
            folded.append(node)
        same = lambda v: [v] * len(digests)
        return pa.table({"doc_id": rows["doc_id"], "leaf": digests, "subroot": same(up["subroot"]), "root": same(up["root"]), "proof_sha256": proof, "folded_root": folded, "verified": [x == up["root"] for x in folded]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = in_blocks(placed).groupBy("tree", "block").cogroup(_down(trees, cut(top)).groupBy("tree", "pos"))
    return blocks.applyInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def _sql_levels(name: str, start: str, count: int) -> str:
    """CTEs of ``count`` levels above ``start(tree, pos, n, h)``: nodes by level, and for each node what stands beside it."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(count):
        beside = lambda rows: f"CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {rows}), '') END"  # noqa: B023, E731
        out.append(f"{name}_s{k} AS MATERIALIZED (SELECT tree, pos, n, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY tree, pos // 8, n)")
    return ",\n".join(out)


def _sql_climb(name: str, rows: str, count: int) -> str:
    """``rows(tree, pos, x, proof, ..)`` with x folded and proof grown by ``count`` levels."""
    for k in range(count):
        rows = f"(SELECT q.* REPLACE (CASE WHEN s.n = 1 THEN q.x ELSE sha256(s.l || q.x || s.r) END AS x, q.proof || s.l || s.r AS proof) FROM {rows} q JOIN {name}_s{k} s ON q.tree = s.tree AND q.pos // {8**k} = s.pos)"
    return rows


def _sql(tree_levels: int = 7, name_levels: int = 3) -> str:
    """All levels written out, 8^7 documents a language and 8^3 languages; crc32 bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', t)))})"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c: list_reduce([xor(a, c)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: {bit})), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    climbed = _sql_climb("t", "(SELECT doc_id, leaf, tree, pos, coalesce(changed, leaf) AS x, '' AS proof FROM placed)", tree_levels)
    whole = _sql_climb("f", f"(SELECT doc_id, leaf, q.x, q.proof, g.subroot, '' AS tree, g.pos FROM {climbed} q JOIN names g ON q.tree = g.name)", name_levels)
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} END AS changed FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_sql_levels("t", "SELECT tree, pos, n, leaf AS h FROM placed", tree_levels)},
names AS MATERIALIZED (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t{tree_levels}),
{_sql_levels("f", "SELECT '' AS tree, pos, count(*) OVER () AS n, subroot AS h FROM names", name_levels)}
SELECT q.doc_id, q.leaf, q.subroot, f.h AS root, sha256(q.proof) AS proof_sha256, q.x AS folded_root, q.x = f.h AS verified FROM {whole} q, f{name_levels} f
"""


OP13_SQL = _sql()
