"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Tasks count the n-grams of their trusted texts; the counts of all tasks are summed by n-gram, and the tables of
one order are joined with their contexts and with the order below, each sharded by its key. A log probability
is written as a sum of weights of the n-grams that end at a position, so documents are scored against one bounded
block of the table after the other and the sums add up, whatever size the table has. A document is rejected if
its perplexity exceeds a limit set by quantiles of its own language's trusted documents, each under a model that has not seen it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import BROADCAST_KEYS, cut, small_batches, table, union_all

#: N-gram order; 16 bits a character, so that an n-gram is one 64-bit integer.
ORDER = 4
#: Rows of the weight table that are broadcast at once (16 bytes each), ids of trusted documents that are.
BLOCK_ROWS, BROADCAST_IDS = 4_000_000, 4_000_000
#: Rows in a part of the tables of counts.
PART_ROWS = 2_000_000
#: Characters that a worker holds at once, characters of average text that are added to a document's own.
CHARS, PRIOR_CHARS = 1 << 18, 50
#: The limit is the median plus this many times the distance from there to the upper quantile.
UPPER, REACH = 0.99, 2.0


def _fold_table() -> np.ndarray:
    fold = np.arange(1 << 16, dtype=np.uint64)
    fold[:33] = fold[127:161] = 32
    fold[48:58] = 48
    return fold


_FOLD = _fold_table()


def units(text: str) -> np.ndarray:
    """The text in UTF-16: a character beyond 16 bits is two units, each pair its own."""
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def grams(text: str, order: int = ORDER) -> list[np.ndarray]:
    """For k in 1..order the packed k-gram that ends at each unit; starts are padded; digits and blanks fold."""
    c = _FOLD[units(text)]
    keys = [c]
    for k in range(1, order):
        shifted = np.full(len(c), 2, np.uint64)
        shifted[k:] = c[:-k] if k < len(c) else c[:0]
        keys.append(keys[-1] | shifted << np.uint64(16 * k))
    return keys


def pieces(text: str | None, chars: int = CHARS, order: int = ORDER):
    """(k-grams, positions to skip) of stretches of the text; a stretch repeats the last characters of the one before."""
    text = text or ""
    for at in range(0, max(1, len(text)), chars):
        back = min(at, order - 1)
        yield grams(text[at - back : at + chars], order), len(units(text[at - back : at]))


class Weights:
    """Vectorised lookup: n-gram -> (own weight, weight as a context); unknown n-grams weigh 0."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, context: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, n = np.uint64(64 - bits), 1 << bits
        self.keys, self.own, self.context = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, np.float32), np.zeros(n, np.float32)
        at = self._slot(keys)
        _, first = np.unique(at, return_index=True)
        self.keys[at[first]], self.own[at[first]], self.context[at[first]] = keys[first], own[first], context[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded = np.zeros(n, bool)
        self.crowded[at[rest]] = True
        rest = rest[np.argsort(keys[rest])]
        self.more = keys[rest], own[rest], context[rest]

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._slot(keys)
        hit = self.keys[at] == keys
        own, context = np.where(hit, self.own[at], 0), np.where(hit, self.context[at], 0)
        missed = np.flatnonzero(~hit & self.crowded[at])
        if len(missed):
            k, o, c = self.more
            j = np.minimum(np.searchsorted(k, keys[missed]), len(k) - 1)
            found = k[j] == keys[missed]
            own[missed[found]], context[missed[found]] = o[j[found]], c[j[found]]
        return own, context


def counts(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram of the highest order occurs in all of ``texts(text)``."""

    def run(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list = []

        def merged():
            k = np.concatenate([keys, *(x for x, _ in waiting)])
            u, inverse = np.unique(k, return_inverse=True)
            return u, np.bincount(inverse, weights=np.concatenate([n, *(y for _, y in waiting)]), minlength=len(u)).astype(np.int64)

        held, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                for g, skip in pieces(t):
                    held.append(g[-1][skip:])
                    size += len(held[-1])
                    if size >= CHARS:
                        waiting.append(np.unique(np.concatenate(held), return_counts=True))
                        held, size = [], 0
                        if sum(len(x) for x, _ in waiting) > max(len(keys), 1 << 20):
                            keys, n = merged()
                            waiting = []
        if held:
            waiting.append(np.unique(np.concatenate(held), return_counts=True))
        keys, n = merged()
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(top: DataFrame, order: int = ORDER) -> tuple[DataFrame, float, float]:
    """((k, gram, own, context), log weight of any character, of the start of a text): additive log weights from ``top(gram, n)``, the counts of the highest order.

    Lower orders count distinct left neighbours. Discounts of counts 1, 2 and 3 or more come from the numbers of
    n-grams with counts 1 to 4 of each order. ``own`` is log P(gram) less what its context and its shorter form
    give already; ``context`` is the log of the mass that the gram, as a context, leaves to shorter forms.
    """
    top = cut(top.select("gram", F.col("n").alias("c")))
    # A table of one part needs no exchange; the parts grow with the rows.
    levels = {order: cut(top.coalesce(-(-top.count() // PART_ROWS) or 1))}
    for k in range(order - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    symbols = levels[1].count() + 1
    gammas, base, start = {}, 0.0, 0.0
    for k in range(1, order + 1):
        n1, n2, n3, n4 = levels[k].agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.9]
        d = [min(max(x, 0.1), 0.95 + i) for i, x in enumerate(d)]
        c = F.col("c")
        discount = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        level = levels[k].select("gram", "c", discount.alias("discount"))
        if k == 1:
            total, left = level.agg(F.sum("c"), F.sum("discount")).first()
            gamma = left / total if total else 1.0
            base = float(np.log(gamma / symbols))
            p = level.select("gram", ((c - F.col("discount")) / F.lit(float(total or 1))).alias("alpha"), F.lit(gamma / symbols).alias("rest"))
        else:
            level = level.withColumns({"context": F.shiftrightunsigned("gram", 16).cast("long"), "shorter": F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1)})
            gammas[k] = cut(level.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("discount") / F.sum("c")).alias("gamma")))
            padding = gammas[k].where(F.col("context") == sum(2 << 16 * i for i in range(k - 1))).first()
            start += float(np.log(padding["gamma"])) if padding else 0.0
            p = level.join(gammas[k], "context").join(levels[k - 1].select(F.col("gram").alias("shorter"), F.col("p").alias("p0")), "shorter")
            p = p.select("gram", ((F.col("c") - F.col("discount")) / F.col("total")).alias("alpha"), (F.col("gamma") * F.col("p0")).alias("rest"))
        levels[k] = cut(p.select(F.lit(k).alias("k"), "gram", (F.col("alpha") + F.col("rest")).alias("p"), (F.log(F.col("alpha") + F.col("rest")) - F.log("rest")).alias("own")))
    weights = []
    for k in range(1, order + 1):
        w = levels[k]
        w = w.join(gammas[k + 1].select(F.col("context").alias("gram"), F.log("gamma").alias("context")), "gram", "left") if k < order else w.withColumn("context", F.lit(0.0))
        weights.append(w.select("k", "gram", F.col("own").cast("float"), F.coalesce("context", F.lit(0.0)).cast("float").alias("context")))
    return cut(union_all(weights)), base, start


def scored(docs: DataFrame, weights: DataFrame, base: float, start: float, order: int = ORDER, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc, n_tokens, log_p): the characters of each text and their log probability, over all blocks of the table."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = max(1, -(-weights.count() // block_rows))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_p"))
    schema = out.schema
    for block in range(blocks):
        rows = weights.where(F.pmod(F.xxhash64("gram", "k"), F.lit(blocks)) == block).toArrow()
        k, gram, own, context = (rows.column(x).to_numpy() for x in ("k", "gram", "own", "context"))
        tables = spark.sparkContext.broadcast([(gram[k == j].view(np.uint64), own[k == j], context[k == j]) for j in range(1, order + 1)])

        def run(batches, tables=tables, base=0.0 if block else base, first=not block):
            look = [Weights(*t) for t in tables.value]

            for b in batches:
                texts = b.column(0).field("text").to_pylist()
                n, log_p = b.column(1).to_numpy().copy(), b.column(2).to_numpy().copy()
                if first:
                    n += np.array([len(t or "") for t in texts], np.int64)
                    log_p += np.where(n > 0, start, 0.0)
                group, owners, size = [], [], 0

                def flush():
                    chars = [np.concatenate([g[j] for g, _ in group]) for j in range(order)]
                    sums = np.full(len(chars[0]), base)
                    starts = np.cumsum([0, *(len(g[0]) for g, _ in group)])[:-1]
                    for j, w in enumerate(look):
                        own, context = w(chars[j])
                        sums += own
                        if j < order - 1:
                            sums[1:] += context[:-1]
                            sums[starts[1:]] -= context[starts[1:] - 1]  # the character before belongs to another text
                    for (_, skip), a in zip(group, starts):
                        sums[a : a + skip] = 0
                    np.add.at(log_p, owners, np.add.reduceat(sums, starts))

                for i, t in enumerate(texts):
                    if not t:
                        continue
                    for g, skip in pieces(t):
                        group.append((g, skip))
                        owners.append(i)
                        size += len(g[0])
                        if size >= CHARS:
                            flush()
                            group, owners, size = [], [], 0
                if group:
                    flush()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(log_p)], b.schema.names)

        out = out.mapInArrow(run, schema)
        if block + 1 < blocks:
            out = cut(out)
    return out


def _language(c: Column) -> Column:
    return F.coalesce(c, F.lit("und"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, language, n_tokens, perplexity, most, keep) per document of ``docs(doc_id, text, lang, ..)``.

    Trusted texts are those that ``labels`` calls of quality 1. Limits are quantiles of their perplexities under the model of the
    other half of them (halves by a hash of the text, so copies stay together), since a text that was learned from looks too
    good; with texts in one half only, they come from the texts that were learned from. Perplexity is per character, with PRIOR_CHARS
    characters of the language's median added, so that a few odd characters do not condemn a short text.
    A language without trusted documents takes the limit of all together. Null and empty texts have no
    characters and are rejected; without any trusted text all others are kept, with null figures. Texts of any length are read
    whole; a perplexity equal to the limit is kept. Repeated rows are judged one by one; a null lang is a language of its
    own. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    ids = cut(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    small_batches(docs.sparkSession)
    trusted = docs.select("doc_id", "text", "lang").where("text <> ''").join(ids, F.col("doc_id") == F.col("_trusted"), "left_semi")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    parts = [cut(counts(trusted.where(half == k))) for k in (0, 1)]
    model = kneser_ney(parts[0].union(parts[1]).groupBy("gram").agg(F.sum("n").alias("n")))
    rate = -F.col("log_p") / F.col("n_tokens")
    if any(p.isEmpty() for p in parts):
        seen = scored(trusted, *model)
    else:
        seen = union_all([scored(trusted.where(half == k), *kneser_ney(parts[1 - k])) for k in (0, 1)])
    seen = cut(seen.select(_language(F.col("doc.lang")).alias("lang"), rate.alias("rate")))
    q = [F.percentile_approx("rate", 0.5, 100_000).alias("mid"), F.percentile_approx("rate", UPPER, 100_000).alias("high")]
    limit = cut(seen.groupBy(F.col("lang").alias("language")).agg(*q))
    limit = F.broadcast(limit) if limit.count() <= BROADCAST_KEYS else limit
    whole = seen.agg(*q).first()
    out = scored(docs, *model).withColumn("language", _language(F.col("doc.lang")))
    out = out.join(limit, "language", "left").withColumns({"mid": F.coalesce("mid", F.lit(whole["mid"])), "high": F.coalesce("high", F.lit(whole["high"]))})
    shrunk = (PRIOR_CHARS * F.col("mid") - F.col("log_p")) / (PRIOR_CHARS + F.col("n_tokens"))
    most = F.col("mid") + REACH * (F.col("high") - F.col("mid"))
    keep = (F.col("n_tokens") > 0) & F.coalesce(shrunk <= most, F.lit(True))
    return out.select("doc", "language", "n_tokens", F.exp(shrunk).alias("perplexity"), F.exp(most).alias("most"), keep.alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``judged`` keeps, with their own columns: no null or empty text; rows that repeat, or share or lack a
    doc_id, are judged one by one by their text; an empty table gives an empty result."""
    return judged(docs, labels).where("keep").select("doc.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "language", "n_tokens", "perplexity", "most", "keep")
