"""The Merkle manifest against a tree that is built whole, level by level."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inkflow.llm import merkle

DOC = "doc_id long, source string, lang string, n_chars int, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, siblings of each leaf by level: (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, p in enumerate(at):
            run = runs[p // 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, at = [digest(*r) for r in runs], [p // 8 for p in at]
    return nodes[0], paths


def plain_leaf(i, source, lang, n, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def plain_proofs(rows):
    leaves = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        leaves.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), plain_leaf(*r[:4], low) if tampered else plain_leaf(*r), r[0]))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([y[2] for y in sorted(leaves[x])]) for x in langs}
    if not langs:
        return []
    root, above = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above):
        for (_, _, leaf, changed, i), path in zip(sorted(leaves[x]), trees[x][1]):
            node = changed
            for left, right in path + up:
                node = digest(left, node, right)
            out.append((i, leaf, trees[x][0], root, digest(*(s for p in path + up for s in p)), node, node == root))
    return out


def got(docs):
    return sorted((tuple(r) for r in merkle.proofs(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 71, 513, 1000])
def test_traversal(n):
    leaves = [digest(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves)
    height = merkle.depth(n)
    walked = [[(left, right) for _, left, right in merkle.steps(runs, i)] for i, runs in enumerate(merkle.traversal(leaves, height))]
    assert walked == paths and merkle.block_root(leaves, height) == root
    assert merkle.block_root(leaves, height + 2) == digest(digest(root))


def test_memory_of_a_walk():
    """A treehash holds unfinished runs of its levels alone, never the leaves."""
    leaves = [str(i) for i in range(4096)]
    t = merkle.TreeHash(leaves, 3)
    for _ in leaves:
        t.advance()
        assert sum(map(len, t.open)) <= 8 * 4 and len(t.run) <= 8


def test_small(spark):
    rng = random.Random(13)
    langs = ["en", "de", None, "", "é", "zz", "\U0001f970", "－", "-", "=", "a", "B"]
    rows = [(rng.choice([None, *range(-5, 90)]), rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, 3]), rng.choice(["Some TEXT", "", None, "ÀÉ Z", "x"])) for _ in range(300)]
    rows += rows[:30] + [rows[0]] * 20 + [(500, "s", "en", 1, "LONG " * 300_000)]
    d = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in ("tree", "pos", "digest", "block", "leaf", "total", "_row", "changed")])
    assert got(d) == sorted(plain_proofs(rows), key=str)


def test_levels_of_blocks(spark):
    """More leaves than a block holds, in one language that has nearly all of them, and a last block of one leaf."""
    rows = [(i * 3, "s", "en", 2, f"Doc {i}") for i in range(2 * 4096 + 1)] + [(i, "s", "de", 2, f"Doc {i}") for i in range(70)]
    random.Random(1).shuffle(rows)
    assert got(spark.createDataFrame(rows, DOC)) == sorted(plain_proofs(rows), key=str)


def test_empty(spark):
    assert got(spark.createDataFrame([], DOC)) == []
    rows = [(None, None, None, None, None)]
    assert got(spark.createDataFrame(rows, DOC)) == plain_proofs(rows)
