"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Documents are dealt to shards by a seeded hash, so that a source of any size is spread. In each shard the
blocks (equal numbers of words) go to the sources by highest quotients target / (2 k - 1). A cell (source and
shard) lays its documents out in seeded order, cuts them into blocks and takes its quota of them in even steps
from a seeded start; quotas above the number of blocks take some blocks twice. What a prefix of the cell yields has a closed
form, so no row per block is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm.common import cut, seeded, table, text_hash

#: Words in a block, documents in a shard, the seed, and the weights that sources take in turn.
BLOCK, SHARD_DOCS, SEED, WEIGHTS = 16, 20_000, 67, (3, 1, 2)
#: All targets together, and the most of one source, as multiples of what is there.
SHARE, MOST = 1.5, 2
#: A word is a run without blanks and the controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: shares by weight, none above ``most`` times its size.

    The least sources for their weight are full first; what they can't take is reshared among the others by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumns({"all_size": F.sum("source_size").over(everything), "full_size": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    w = w.withColumn("full", most * F.col("source_size") * F.col("left_weight") < (share * F.col("all_size") - most * F.col("full_size")) * F.col("weight"))
    rest = w.withColumns({"full_sum": F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0)), "open_weight": F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)})
    open_target = (share * F.col("all_size") - most * F.col("full_sum")) * F.col("weight") / F.col("open_weight")
    return rest.select("source", "source_size", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(open_target).alias("target"))


def quotas(cells: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``cells(source, shard, words, share)`` with integer ``quota`` of blocks and ``blocks``, the number that is there.

    Each shard's blocks go to its sources by highest quotients. Seats that every source surely wins are counted
    in one step; only the few quotients around the last seat are listed and ranked.
    """
    shard = Window.partitionBy("shard")
    c = cells.where("share > 0").withColumns({"votes": F.sum("share").over(shard), "n": F.count(F.lit(1)).over(shard)})
    c = c.withColumn("seats", F.round(F.col("votes") / block).cast("long"))
    sure = F.when(F.col("seats") * 2 > F.col("n"), F.floor(F.col("share") * (F.col("seats") - F.col("n") / 2) / F.col("votes") + 0.5) - 1).otherwise(0)
    c = c.withColumn("sure", F.greatest(F.lit(0), sure).cast("long"))
    c = c.withColumn("may", F.greatest(F.col("sure") + 1, (F.floor(F.col("share") * (F.col("seats") + F.col("n") / 2) / F.col("votes") + 0.5) + 1).cast("long")))
    c = c.withColumn("open", F.col("seats") - F.sum("sure").over(shard))
    tried = c.withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("may"))))
    best = Window.partitionBy("shard").orderBy((F.col("share") / (2 * F.col("k") - 1)).desc(), F.col("source").asc_nulls_last(), "k")
    won = tried.withColumn("place", F.row_number().over(best)).groupBy("source", "shard", "words", "sure").agg(F.count(F.when(F.col("place") <= F.col("open"), 1)).alias("more"))
    blocks = F.ceil(F.col("words") / block).cast("long")
    return won.select("source", "shard", "words", F.least(F.col("sure") + F.col("more"), most * blocks).alias("quota"), blocks.alias("blocks"))


def mix(docs: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, taken.

    Null and wordless texts have size 0 and are taken 0 times; texts of any length are read whole. A null source is a
    source of its own, the last in order. The seeded place of a document follows from its doc_id and text, so rows that repeat or
    lack a doc_id are dealt out like others; rows alike in both are documents of their own, next to each other. Ties are
    broken by id, size and text, so reruns agree. Other columns are not read; an empty table gives an empty result.
    """
    key = seeded(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))
    sized = docs.select("doc_id", "source", text_hash(F.col("text")).alias("text_hash"), word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = cut(sized)
    shards = max(1, -(-sized.count() // shard_docs))
    sized = sized.withColumn("shard", F.pmod("key", F.lit(shards)))
    cells = cut(sized.groupBy("source", "shard").agg(F.sum("size").alias("words")))
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = cut(goal)
    same = lambda a, b, *on: [a[k].eqNullSafe(b[k]) for k in on]
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)
    quota = quotas(cells.join(goal, same(cells, goal, "source")).select(cells["source"], "shard", "words", share.alias("share")), block)
    quota = cut(quota)
    plan = cells.join(goal, same(cells, goal, "source")).drop(goal["source"])
    plan = plan.join(quota, same(plan, quota, "source", "shard"), "left").select(plan["source"].alias("_source"), plan["shard"].alias("_shard"), "source_size", "target", "quota", "blocks")
    plan = plan.withColumn("start", F.pmod(seeded(seed, F.col("_source"), F.col("_shard")), F.col("blocks")))
    laid = sized.withColumn("end", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)))
    d = laid.join(plan, laid["source"].eqNullSafe(plan["_source"]) & (laid["shard"] == plan["_shard"]))

    def yielded(words: Column) -> Column:
        """Words that the first ``words`` words of a cell give; picked(j) is how many picks fall on its first j blocks."""
        picked = lambda j: F.expr("(%s * quota + start) div blocks" % j)
        j = f"({words} div {block})"
        return block * picked(j) + F.expr(f"{words} % {block}") * (picked(f"({j} + 1)") - picked(j))

    taken = F.when(F.col("quota") > 0, yielded("`end`") - yielded("(`end` - size)")).otherwise(0).cast("long")
    return d.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with their own columns, ``target`` (their source's) and ``taken``.

    Columns of these two names in ``docs`` are replaced by the mix's; all others pass through, whatever they are called. Rows with
    equal doc_id, source and text share evenly, rounded down, what they take together. Null, empty and wordless texts are
    not taken. An empty table gives an empty result.
    """
    keys = ("doc_id", "source", "text_hash")
    plan = mix(docs).groupBy(*keys).agg(F.max("target").alias("target"), F.expr("sum(taken) div count(1)").alias("taken")).where("taken > 0")
    own = [c for c in docs.columns if c not in ("target", "taken")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), text_hash(F.col("text")).alias("_text"))
    same = d["_doc"]["doc_id"].eqNullSafe(plan["doc_id"]) & d["_doc"]["source"].eqNullSafe(plan["source"]) & (d["_text"] == plan["text_hash"])
    return d.join(plan.hint("shuffle_hash"), same).select(*[F.col(f"_doc.`{c}`").alias(c) for c in own], "target", "taken")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix for an engine with md5, 64-bit integers and window functions.
OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS key FROM documents),
dealt AS (SELECT *, key % (SELECT greatest(1, (count(*) + {SHARD_DOCS - 1}) // {SHARD_DOCS}) FROM sized) AS shard FROM sized),
cells AS (SELECT source, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL),
sources AS (SELECT source, sum(words)::BIGINT AS source_size FROM cells GROUP BY ALL),
weighed AS (SELECT *, ({list(WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM sources),
filled AS (
  SELECT *, {SHARE}::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER b, 0)::BIGINT AS full_size, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight
  FROM weighed WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, {MOST} * source_size * left_weight < (total - {MOST} * full_size) * weight AS is_full FROM filled),
goal AS (
  SELECT source, source_size, CASE WHEN is_full THEN ({MOST} * source_size)::DOUBLE
         ELSE (total - {MOST} * coalesce(sum(source_size) FILTER (is_full) OVER (), 0)::BIGINT) * weight / (sum(weight) FILTER (NOT is_full) OVER ()) END AS target FROM marked),
shares AS (
  SELECT c.source, shard, words, CASE WHEN source_size > 0 THEN target * words / source_size ELSE 0.0::DOUBLE END AS share
  FROM cells c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
votes AS (SELECT *, sum(share) OVER (PARTITION BY shard) AS votes, count(*) OVER (PARTITION BY shard) AS n FROM shares WHERE share > 0),
seats AS (SELECT *, round(votes / {BLOCK})::BIGINT AS seats FROM votes),
ranked AS (
  SELECT source, shard, share, words, seats, unnest(range(1, floor(share * (seats + n / 2.0) / votes + 0.5)::BIGINT + 3)) AS k FROM seats),
won AS (
  SELECT source, shard, words, count(*) FILTER (place <= seats) AS seats FROM (
    SELECT *, row_number() OVER (PARTITION BY shard ORDER BY share / (2 * k - 1) DESC, source NULLS LAST, k) AS place FROM ranked) GROUP BY ALL),
quota AS (SELECT source, shard, least(seats, {MOST} * ((words + {BLOCK - 1}) // {BLOCK}))::BIGINT AS quota, (words + {BLOCK - 1}) // {BLOCK} AS blocks FROM won),
plan AS (
  SELECT c.source, c.shard, source_size, target, quota, blocks,
         ('0x' || substr(md5('{SEED}:' || coalesce(c.source, 'null') || ':' || c.shard), 1, 12))::BIGINT % blocks AS start
  FROM cells c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source
  LEFT JOIN quota q ON c.source IS NOT DISTINCT FROM q.source AND c.shard = q.shard),
laid AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS z FROM dealt),
cut AS (SELECT l.*, z - size AS a, source_size, target, quota, blocks, start FROM laid l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source AND l.shard = p.shard)
SELECT doc_id, size, source_size, target, CASE WHEN quota > 0 THEN
    {BLOCK} * (((z // {BLOCK}) * quota + start) // blocks) + (z % {BLOCK}) * ((((z // {BLOCK}) + 1) * quota + start) // blocks - ((z // {BLOCK}) * quota + start) // blocks)
  - {BLOCK} * (((a // {BLOCK}) * quota + start) // blocks) - (a % {BLOCK}) * ((((a // {BLOCK}) + 1) * quota + start) // blocks - ((a // {BLOCK}) * quota + start) // blocks)
  ELSE 0 END::BIGINT AS taken FROM cut
"""
