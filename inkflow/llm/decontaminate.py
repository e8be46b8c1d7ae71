"""Benchmark decontamination by a prefix-filtered containment join.

A window (item-sized, ``window`` words at most) is a set of shingles. Containment has to be whole, so a prefix of
one shingle suffices: the window's rarest over all documents. Documents are joined on these prefix shingles
only; a match fixes the place of the window in the document, which bounds it on both sides (position and
length), and the words there are compared one by one.

The index of a block of items is a few sorted arrays of numbers beside the items' words, some ten bytes for each
character of a block's items, which every task searches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import cut, small_batches, table

#: Characters of items that are held at once; a larger benchmark is taken block by block, each over all documents.
BLOCK_CHARS = 16_000_000
#: Bytes that are no part of a word become blanks, A-Z become a-z; bytes from 0x80 on are parts of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Odd, so that its powers can be undone; bytes whose numbers are made at once.
_BASE, _PIECE = 0x9E3779B97F4A7C15, 1 << 20
_powers = np.ones((2, 1), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base and of its inverse (modulo 2^64), up to the n-th; made once for a process and longer when longer words come."""
    global _powers
    if _powers.shape[1] <= n:
        more = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64).repeat(max(n, 2 * _powers.shape[1]), axis=1)
        _powers = np.concatenate([np.ones((2, 1), np.uint64), np.cumprod(more, axis=1, dtype=np.uint64)], axis=1)
    return _powers


class Words:
    """The words of a text: folded bytes, where each word begins and ends in them, and a number for each, equal for equal words."""

    def __init__(self, text: str | None):
        self.folded = (text or "").encode().translate(_FOLD)
        inside = np.zeros(len(self.folded) + 2, bool)
        inside[1:-1] = np.frombuffer(self.folded, np.uint8) != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]

    def __len__(self) -> int:
        return len(self.start)

    def numbers(self) -> np.ndarray:
        """Sums of bytes times powers of the base, differences of sums over the text, so that no word is looked at by itself."""
        out, i = np.empty(len(self), np.uint64), 0
        while i < len(self):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + _PIECE, side="right")))
            high = self.end[j - 1]
            power, inverse = _powers_to(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(np.frombuffer(self.folded, np.uint8, high - low, low) * power[: high - low], out=sums[1:])
            begin, stop = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = (sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)
            i = j
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)

    def spelled(self, i: int, j: int) -> bytes:
        """Words ``i`` up to ``j`` with single blanks between."""
        return b" ".join(self.folded[self.start[i] : self.end[j - 1]].split())


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The number of the shingle of ``width`` words that begins at each word; equal shingles have equal numbers."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def held(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place of each of ``found`` in the ascending ``keys``, -1 if it is not there."""
    if not len(keys):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at, -1)


class Sieve:
    """Which leading bits the keys have, so that a key is searched for only where one may be: most shingles of a text are none of an item's."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.shift, self.mark = keys, np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.mark[keys >> self.shift] = True

    def places(self, found: np.ndarray) -> np.ndarray:
        """Those of ``found``, by their places, that are keys."""
        may = np.flatnonzero(self.mark[found >> self.shift])
        return may[held(self.keys, found[may]) >= 0]


class Windows:
    """The windows of a block of items: words one after the other, and where the windows begin and how many words they have."""

    def __init__(self, items, size: int, width: int):
        hashes, text, sizes, starts, lengths, owners, names = [], [], [], [], [], [], []
        place = 0
        for name, t in items:
            ws = Words(t)
            if not len(ws):
                continue
            n = max(1, len(ws) - size + 1)
            starts.append(np.arange(place, place + n))
            lengths.append(np.full(n, min(size, len(ws)), np.int16))
            owners.append(np.full(n, len(names), np.int32))
            names.append(name)
            hashes.append(ws.numbers())
            sizes.append(ws.end - ws.start + 1)
            text.append(ws.spelled(0, len(ws)) + b" ")
            place += len(ws)
        join = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        self.names, self.text, self.width = names, b"".join(text), width
        self.hashes, self.begin = join(hashes, np.uint64), np.concatenate([[0], np.cumsum(join(sizes, np.int64))])
        start, length, owner = join(starts, np.int64), join(lengths, np.int16), join(owners, np.int32)
        self._distinct(start, length, owner)
        #: By width: the shingles that windows hold, ascending.
        self.known = {}
        for k in sorted({min(width, int(n)) for n in np.unique(self.length)}):
            own = np.minimum(self.length, width) == k
            at = np.unique(np.concatenate([self.start[own & (self.length == n)][:, None] + np.arange(int(n) - k + 1) for n in np.unique(self.length[own])], axis=None))
            self.known[k] = np.unique(shingles(self.hashes, k)[at])

    def spelled(self, start: int, length: int) -> bytes:
        return self.text[self.begin[start] : self.begin[start + length] - 1]

    def _distinct(self, start, length, owner):
        """Equal windows once, with the items of each."""
        whole = np.zeros(len(start), np.uint64)
        for n in np.unique(length):
            whole[length == n] = shingles(self.hashes, int(n))[start[length == n]] + np.uint64(n)
        order = np.argsort(whole, kind="stable")
        start, length, owner, whole = start[order], length[order], owner[order], whole[order]
        lead = np.ones(len(start), bool)
        lead[1:] = whole[1:] != whole[:-1]
        at = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
        for i in np.flatnonzero(~lead):  # numbers may be equal by chance: then the words differ, and so do the windows
            j = at[i]
            if length[i] != length[j] or self.spelled(start[i], length[i]) != self.spelled(start[j], length[j]):
                lead[i], at[i] = True, i
        number = np.cumsum(lead) - 1
        self.start, self.length = start[lead], length[lead]
        pairs = np.unique(np.stack([number[at], owner.astype(np.int64)], axis=1), axis=0)
        self.items, self.first = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(lead.sum() + 1))

    def index(self, counts: dict[int, np.ndarray]) -> dict[int, tuple]:
        """By width: (prefix shingles ascending, offset in the window, window). A window with a shingle that no document has is left out."""
        out = {}
        for k, keys in self.known.items():
            order = np.lexsort((keys, counts[k]))
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            s = shingles(self.hashes, k)
            parts: list = []
            for n in np.unique(self.length[np.minimum(self.length, self.width) == k]):
                own = np.flatnonzero(self.length == n)
                for c in range(0, len(own), 1 << 17):
                    w = own[c : c + (1 << 17)]
                    all_ = held(keys, s[self.start[w][:, None] + np.arange(int(n) - k + 1)].ravel()).reshape(len(w), -1)
                    best = rank[all_].argmin(axis=1)
                    key = all_[np.arange(len(w)), best]
                    there = counts[k][key] > 0
                    parts.append((keys[key[there]], best[there].astype(np.int16), w[there]))
            key, offset, window = (np.concatenate([x[i] for x in parts]) for i in range(3))
            at = np.argsort(key, kind="stable")
            out[k] = key[at], offset[at], window[at]
        return out


def _hits(ws: Words, index: dict, sieves: dict[int, Sieve], windows: Windows) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items, seen, h = [], set(), set(), ws.numbers()
    for k, (keys, offsets, owned) in index.items():
        s = shingles(h, k)
        for i in sieves[k].places(s):
            for j in range(np.searchsorted(keys, s[i]), np.searchsorted(keys, s[i], side="right")):
                w = owned[j]
                a, n = int(i - offsets[j]), int(windows.length[w])
                if a >= 0 and a + n <= len(ws) and ws.spelled(a, a + n) == windows.spelled(windows.start[w], n):
                    spans.append((a, a + n))
                    if w not in seen:
                        seen.add(w)
                        items.update(windows.names[x] for x in windows.items[windows.first[w] : windows.first[w + 1]])
    return spans, items


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, width: int = 3, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, n_words, spans, items) per document: ``doc`` holds the document's own columns, whatever their names.

    ``spans`` are the hit word ranges (end exclusive, merged, in order), ``items`` the ids as sorted strings.
    Null and wordless texts have no words and no hits; texts of any length are read whole. A null item_id counts as an item of its
    own, written "null"; rows that repeat an item_id are one item; of equally rare shingles any may be the prefix, with the
    same result. Repeated documents are judged one by one. An empty benchmark hits nothing, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    span = "array<struct<a:int,b:int>>"
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(0).cast("long").alias("n_words"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for block in range(blocks):
        own = Windows(((r["item"], r["text"]) for r in bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toLocalIterator()), window, width)
        sent = spark.sparkContext.broadcast(own.known)

        def counted(batches, sent=sent):
            seen = {k: np.zeros(len(v), np.int64) for k, v in sent.value.items()}
            sieves = {k: Sieve(v) for k, v in sent.value.items()}
            for b in batches:
                for t in b.column(0).to_pylist():
                    h = Words(t).numbers()
                    for k, keys in sent.value.items():
                        s = shingles(h, k)
                        seen[k][np.unique(held(keys, s[sieves[k].places(s)]))] += 1
            for k, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["k", "id", "n"])

        # One row at most per shingle of this block's items.
        counts = {k: np.zeros(len(v), np.int64) for k, v in own.known.items()}
        if counts:
            t = docs.select("text").mapInArrow(counted, "k int, id long, n long").groupBy("k", "id").agg(F.sum("n").alias("n")).toArrow()
            k, i, n = (t.column(c).to_numpy() for c in ("k", "id", "n"))
            for x in counts:
                counts[x][i[k == x]] = n[k == x]
        index = spark.sparkContext.broadcast((own.index(counts), own))

        def matched(batches, index=index):
            prefixes, own = index.value
            sieves = {k: Sieve(keys) for k, (keys, _, _) in prefixes.items()}
            for b in batches:
                new: list = [[], [], []]
                for t, spans, items in zip(b.column(0).field("text").to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    ws = Words(t)
                    more, found = _hits(ws, prefixes, sieves, own)
                    new[0].append(len(ws))
                    new[1].append([{"a": x, "b": y} for x, y in _union([*((s["a"], s["b"]) for s in spans), *more])])
                    new[2].append(sorted({*items, *found}))
                kinds = (pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, new, kinds)], b.schema.names)

        out = out.mapInArrow(matched, schema)
        if block + 1 < blocks:
            out = cut(out)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their own columns.

    Null, empty and wordless texts stay; rows that repeat, or share a doc_id, are judged one by one; ids are not looked at. An
    empty table gives an empty result, an empty benchmark keeps all.
    """
    return contamination(docs, benchmark).where(F.size("spans") == 0).select("doc.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: Every window against every stretch of words of its length.
OP4_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
hit AS (SELECT r, i, n, item FROM grams JOIN win USING (n, g)),
per AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN per USING (r) LEFT JOIN items USING (r)
"""
