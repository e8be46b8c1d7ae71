"""Text to output ids. One vectorised pass over the UTF-8 bytes of each text, or of each piece of a long one."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkflow.functions.batches import arrow_function
from inkflow.functions.text import best_path
from inkflow.functions.vocab import tokens

BOS_ID, EOS_ID, FIRST_BYTE_ID = 2, 3, 101
#: Characters of a text that are encoded at once.
PIECE = 1 << 16


def single_ids(codes: list[tuple[str, str]] = (), words: list[str] = ()) -> np.ndarray:
    """Output id of every code point that is one token, -1 for those that fall back to bytes; shape codes come first."""
    table = np.full(0x110000, -1, np.int32)
    for i, t in enumerate(tokens(words)):
        if i >= 26 and len(t) == 1:
            table[ord(t)] = i - 26
    index: dict[str, int] = {}
    for _, code in codes:
        index.setdefault(code, len(tokens(words)) - 26 + len(index))
    for char, code in codes:
        table[ord(char)] = index[code]
    return table


def ids_of(text: str, table: np.ndarray) -> np.ndarray:
    """Ids of each character, piece by piece: what is made beside the ids does not grow with the text."""
    if len(text) > PIECE:
        return np.concatenate([ids_of(text[i : i + PIECE], table) for i in range(0, len(text), PIECE)])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int32)
    starts = (raw & 0xC0) != 0x80
    known = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    of_byte = known[np.cumsum(starts) - 1]
    ids = np.where(of_byte >= 0, of_byte, raw.astype(np.int32) + FIRST_BYTE_ID)
    return ids[starts | (of_byte < 0)]


def coin(seed: int, doc: str, place: int) -> float:
    """A reproducible number in [0, 1) for a word of a document."""
    return int(hashlib.md5(f"{seed}:{doc}:{place}".encode()).hexdigest()[:8], 16) / 2**32


def encoder(codes: list[tuple[str, str]] = (), words: list[str] = (), freq: dict[str, int] | None = None, keep: float = 0.5, seed: int = 67):
    """A function of (document id, text) columns that gives output ids.

    A text is segmented into words; one that is a direct token stays whole if its coin exceeds 1 - ``keep``,
    else its characters are encoded: by shape code, as a direct token, or by their bytes.
    """
    direct = {t: i - 26 for i, t in enumerate(tokens(words)) if i >= 26}
    freq = dict(freq or {}) or {w: 1 for w in words}
    longest, total = max(map(len, freq), default=1), sum(freq.values())
    codes, words = list(codes), list(words)
    held: list = []

    def run(docs: pa.Array, texts: pa.Array) -> pa.Array:
        if not held:
            table = single_ids(codes, words)
            # A text is cut only if some word that a path can hold is more than its characters.
            whole = bool(codes or words) and keep > 0 and any(table[ord(w)] != i if len(w) == 1 else freq.get(w, 0) > 0 for w, i in direct.items())
            held.append((table, whole))
        (table, whole), out = held[0], []
        for doc, text in zip(docs.to_pylist(), texts.to_pylist()):
            if text is None or not whole or text.isascii():
                out.append(ids_of(text or "", table))
                continue
            parts, plain = [], ""
            for place, w in enumerate(best_path(text, freq, longest, total)):
                if w in direct and keep > 0 and coin(seed, str(doc), place) >= 1 - keep:
                    parts += [ids_of(plain, table), np.array([direct[w]], np.int32)]
                    plain = ""
                else:
                    plain += w
            out.append(np.concatenate([*parts, ids_of(plain, table)]))
        sizes = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))

    return arrow_function(run, "array<int>")


def framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS_ID)), ids, F.array(F.lit(EOS_ID)))


def n_tokens(text: Column) -> Column:
    """Rows that a framed text without shape codes or words gives: one for each byte, and two."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 2).cast("long")


def strict_ids(text: Column, codes: list[tuple[str, str]] = (), words: list[str] = ()) -> Column:
    """One id for each character, which must have a shape code or be a direct token; any other is an error."""
    codes, words = list(codes), list(words)
    held: list[np.ndarray] = []

    def strict(text: pa.Array) -> pa.Array:
        if not held:
            held.append(single_ids(codes, words))
        out = []
        for t in text.to_pylist():
            ids = None if t is None else held[0][np.frombuffer(t.encode("utf-32-le"), np.uint32)]
            if ids is not None and (ids < 0).any():
                raise ValueError(f"neither a shape code nor a direct token: {t[int(np.argmax(ids < 0))]}")
            out.append(ids)
        return pa.array(out, pa.list_(pa.int32()))

    return arrow_function(strict, "array<int>")(text)
