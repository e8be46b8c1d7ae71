"""Output ids back to text: tokens, byte runs, candidates and their disambiguation."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions.batches import arrow_function
from inkflow.functions.text import CJK, utf8_runs
from inkflow.functions.vocab import FIRST_BYTE, PAD, ROW, code_candidates, tokens

BEAMS, CONTEXT, UNRANKED, WORST = 4, 12, 3500, 20_000


def decoded(ids: DataFrame, outputs: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``ids(.., output_id)`` with token (direct outputs) or candidates (shape codes)."""
    labelled = ids.join(F.broadcast(outputs.select("output_id", "label", (F.col("row")[0] >= 26).alias("_direct"))), "output_id", "left")
    out = labelled.withColumn("token", F.when(F.col("_direct"), F.col("label")))
    if codes is None:
        return out.drop("label", "_direct").withColumn("candidates", F.lit(None).cast("array<string>"))
    chars = code_candidates(codes).select(F.col("code").alias("_code"), F.col("chars").alias("candidates"))
    return out.join(chars, (F.col("label") == F.col("_code")) & ~F.col("_direct"), "left").drop("label", "_direct", "_code")


def candidates_of_symbols(symbols: Column) -> Column:
    """The code that a list of symbols spells: the fourth character of each, where that is a letter; padding has none."""
    letters = F.filter(F.transform(symbols, lambda s: F.substring(s, 4, 1)), lambda c: c.between("a", "z"))
    return F.array_join(letters, "")


def candidates_of_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds candidates to ``rows(symbols, ..)``: the characters of the code that the symbols spell; one that no character has is an error."""
    chars = code_candidates(codes).select(F.col("code").alias("_code"), F.col("chars").alias("_chars"))
    found = rows.withColumn("_spelled", candidates_of_symbols(F.col("symbols"))).join(chars, F.col("_spelled") == F.col("_code"), "left")
    missed = F.raise_error(F.concat(F.lit("no character has the code "), "_spelled")).cast("array<string>")
    return found.withColumn("candidates", F.coalesce("_chars", missed)).drop("_spelled", "_code", "_chars")


def rows_of_symbols(symbols: Column, words: list[str] = ()) -> Column:
    """Rows of token ids of a list of symbols: five make one row, each of which has to be a token; of any other list the first one is
    looked up, and is spelled in bytes, a row each, if it is no token."""
    table = {t: i for i, t in enumerate(tokens(list(words)))}
    pad = [PAD] * (ROW - 1)

    def one(s: list[str]) -> list[list[int]]:
        if len(s) == ROW:
            missed = [x for x in s if x not in table]
            if missed:
                raise ValueError(f"no token: {missed[0]}")
            return [[table[x] for x in s]]
        if not s:
            return []
        return [[table[s[0]], *pad]] if s[0] in table else [[b + FIRST_BYTE, *pad] for b in s[0].encode()]

    def rows(symbols: pa.Array) -> pa.Array:
        return pa.array([None if s is None else one(s) for s in symbols.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return arrow_function(rows, "array<array<int>>")(symbols)


def first_ids_of_symbols(symbols: Column, words: list[str] = ()) -> Column:
    """For a list of single symbols the first ids of the rows that ``rows_of_symbols`` gives for each, joined by semicolons; an empty symbol has none.

    A symbol is spelled once for each slice of a batch, and texts stay whole: no row is made of a symbol.
    """
    table = {t: str(i) for i, t in enumerate(tokens(list(words))) if t}

    def spelled(symbols: pa.Array) -> pa.Array:
        flat = symbols.flatten().dictionary_encode()
        of = [None if s is None else table[s] if s in table else ";".join(str(b + FIRST_BYTE) for b in s.encode()) for s in flat.dictionary.to_pylist()]
        sizes = pa.compute.fill_null(pa.compute.list_value_length(symbols), 0).to_numpy(zero_copy_only=False)
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(of, pa.string()).take(flat.indices))
        return pa.compute.if_else(symbols.is_valid(), out, pa.scalar(None, out.type)) if symbols.null_count else out

    return arrow_function(spelled, "array<string>")(symbols)


def symbols_of(text: Column, codes: dict[str, str]) -> Column:
    """For each character its five symbols, or itself."""
    table = {c: ([f"cj_{y}" for y in code] + ["[PAD]"] * ROW)[:ROW] for c, code in codes.items()}

    def symbols(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [table.get(c, [c]) for c in t] for t in text.to_pylist()], pa.list_(pa.list_(pa.string())))

    return arrow_function(symbols, "array<array<string>>")(text)


def merged_bytes(ids: DataFrame, key: str = "doc_id", pos: str = "pos", first_byte: int = 101) -> DataFrame:
    """``ids(key, pos, output_id, label)`` -> (key, pos, token): runs of byte tokens become text, an invalid run one mark."""
    byte = F.col("output_id").between(first_byte, first_byte + 255)
    run = F.when(byte, F.col(pos) - F.row_number().over(Window.partitionBy(key, byte).orderBy(pos)))
    d = ids.withColumns({"_byte": byte, "_run": run})
    hexed = F.upper(F.lpad(F.hex(F.col("output_id") - first_byte), 2, "0"))
    runs = d.where("_byte").groupBy(key, "_run").agg(F.min(pos).alias(pos), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, hexed.alias("h")))), lambda x: x["h"]), "").alias("_hex"))
    text = utf8_runs(F.unhex("_hex"))
    return runs.select(key, pos, text.alias("token")).union(d.where("not _byte").select(key, pos, F.col("label")))


def merged_tokens(ids: Column, labels: list[str], first_byte: int = 101) -> Column:
    """The tokens of a list of output ids, where runs of bytes are text, an invalid run one mark; ``labels`` are those of the ids from 0.

    What ``merged_bytes`` does for rows, for whole lists: nothing is shuffled.
    """

    def tokens_of(ids: pa.Array) -> pa.Array:
        flat, rows = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(rows)
        byte = (flat >= first_byte) & (flat <= first_byte + 255)
        begins = np.ones(len(flat), bool)
        begins[1:] = ~byte[1:] | ~byte[:-1]
        begins[(ends - rows)[rows > 0]] = True
        at = np.flatnonzero(begins)
        raw, stops = np.where(byte, flat - first_byte, 0).astype(np.uint8).tobytes(), np.append(at[1:], len(flat))
        run = byte[at]
        texts = [raw[a:b].decode("utf-8", "strict") if _is_utf8(raw[a:b]) else "\ufffd" for a, b in zip(at[run].tolist(), stops[run].tolist())]
        which = flat[at]
        which[run] = len(labels) + np.arange(len(texts))
        before = np.concatenate([[0], np.cumsum(begins)])
        offsets = np.concatenate([[0], before[ends]]).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(offsets), pa.array([*labels, *texts], pa.string()).take(pa.array(which)))
        return pa.compute.if_else(ids.is_valid(), out, pa.scalar(None, out.type)) if ids.null_count else out

    return arrow_function(tokens_of, "array<string>")(ids)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def context_of(parts: Column, most: int = CONTEXT) -> Column:
    """The last single characters of a list of tokens; ``most`` of 0 or less takes all."""
    single = F.filter(parts, lambda t: F.char_length(t) == 1)
    last = single if most <= 0 else F.slice(single, F.greatest(F.lit(1), F.size(single) - most + 1), most)
    return F.array_join(last, "")


def best_word(context: Column, words: Column) -> Column:
    """Of ``words`` (rank, word, freq) those whose beginning ends the context: the best by length, frequency, rank; else zeros."""
    fits = F.filter(words, lambda w: F.endswith(context, F.substring(w["word"], F.lit(1), F.char_length(w["word"]) - 1)))
    scores = F.transform(fits, lambda w: F.array(F.char_length(w["word"]).cast("long"), w["freq"].cast("long"), -w["rank"].cast("long")))
    return F.coalesce(F.array_max(scores), F.array(*[F.lit(0).cast("long")] * 3))


@dataclass
class Lexicon:
    """What disambiguation knows: frequencies, ranks of single characters, and common words by their last one."""

    freq: dict[str, int]
    rank: dict[str, int] = field(init=False)
    ending: dict[str, list[tuple[str, int, int]]] = field(init=False)

    def __post_init__(self):
        cjk = lambda s: all(any(a <= ord(c) <= b for a, b in CJK) for c in s)
        known = [(w, f) for w, f in self.freq.items() if f > 0 and cjk(w)]
        chars = sorted(((w, f) for w, f in known if len(w) == 1), key=lambda x: (-x[1], x[0]))[:UNRANKED]
        words = sorted(((w, f) for w, f in known if 2 <= len(w) <= 4), key=lambda x: (-x[1], -len(x[0]), x[0]))[:WORST]
        self.rank = {w: i for i, (w, _) in enumerate(chars)}
        self.ending = defaultdict(list)
        for i, (w, f) in enumerate(words):
            self.ending[w[-1]].append((w, i, f))

    def score(self, context: str, char: str) -> tuple[int, ...]:
        """Eight figures, compared in order: the best common word that ends here, the most frequent word with it, and itself."""
        word = max(((len(w), f, -i) for w, i, f in self.ending.get(char, ()) if context.endswith(w[:-1])), default=(0, 0, 0))
        longest = max(self.freq.get(context[i:] + char, 0) for i in range(len(context) + 1))
        basic = CJK[1][0] <= ord(char) <= CJK[1][1]
        return (*word, longest, int(char in self.rank), self.freq.get(char, 0), int(basic), -self.rank.get(char, UNRANKED))


def best_reading(items: list[str | list[str]], lexicon: Lexicon, beams: int = BEAMS, context: int = CONTEXT) -> list[str]:
    """The tokens of the best beam; equal scores keep their order.

    Candidates are single characters, so beams of one length never spell the same text. A beam is its score, the
    characters before, and a chain of what it chose; what is certain is noted once and belongs to all.
    """
    held: list[tuple[tuple[int, ...], str, tuple | None]] = [((0,) * 8, "", None)]
    certain: list[str] = []
    for item in items:
        singles = [item] if isinstance(item, str) else list(dict.fromkeys(c for c in item if len(c) == 1))
        if isinstance(item, str) or not singles:
            certain.append(item if isinstance(item, str) else item[0] if item else "")
            continue
        if len(held) == len(singles) == 1:  # whatever it scores, all beams to come have it
            certain.append(singles[0])
            continue
        since = "".join(t for t in certain if len(t) == 1)
        grown = []
        for s, before, chain in held:
            before += since
            before = before[-context:] if context > 0 else before
            grown += [(tuple(a + b for a, b in zip(s, lexicon.score(before, c))), before + c, (chain, certain, c)) for c in singles]
        held, certain = sorted(grown, key=lambda x: x[0], reverse=True)[:beams], []
    parts, chain = [certain], held[0][2]
    while chain:
        chain, sure, c = chain
        parts.append([*sure, c])
    return [t for p in reversed(parts) for t in p]


def detokenizer(codes: list[tuple[str, str]], freq: dict[str, int], words: list[str] = (), bracketed: bool = False):
    """A function of a column of output ids that gives their text, or ``[token]`` by token."""
    direct = tokens(words)[26:]
    by_code: dict[str, list[str]] = defaultdict(list)
    for char, code in codes:
        by_code[code].append(char)
    readings = [*by_code.values()]
    held: list[Lexicon] = []

    spelled = [t.encode() for t in direct]
    spelled[101:357] = [bytes([i]) for i in range(256)]

    def one(ids: list[int]) -> str:
        if not bracketed and max(ids, default=0) < len(spelled):
            try:  # whole texts are UTF-8 exactly if each of their byte runs is
                return b"".join(map(spelled.__getitem__, ids)).decode()
            except UnicodeDecodeError:
                pass
        items: list = []
        run = bytearray()
        for i in [*ids, None]:
            if i is not None and 101 <= i <= 356:
                run.append(i - 101)
                continue
            if run:
                try:
                    items.append(run.decode())
                except UnicodeDecodeError:
                    items.append("�")
                run = bytearray()
            if i is not None:
                items.append(direct[i] if i < len(direct) else readings[i - len(direct)])
        out = best_reading(items, held[0])
        return "".join(f"[{t}]" for t in out if t) if bracketed else "".join(out)

    def decode(ids: pa.Array) -> pa.Array:
        if not held:
            held.append(Lexicon(freq))
        return pa.array([None if x is None else one(x) for x in ids.to_pylist()], pa.string())

    return arrow_function(decode, "string")

