"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

A text is taken as words with single blanks between, so one pass of the automaton finds every phrase whatever marks or
line ends stand inside it. Behind an identifier tag and its colon an expression of licence names with and, or, with and brackets is
read from the text itself and evaluated: ``or`` gives the reader the freer side, ``and`` the stricter one, an exception softens copyleft.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkflow.llm.common import small_batches, table


@dataclass(frozen=True)
class Phrase:
    """``label`` of the notice, or None for an identifier tag; ``certainty`` that the words are a notice; ``base`` phrases count as places."""

    words: str
    label: str | None
    certainty: float = 0.9
    base: bool = False


#: The base, whole notices, short names that may be said in passing, and tags.
PHRASES = (
    Phrase("under the mit license", "mit", base=True), Phrase("apache license version 2", "apache-2", base=True), Phrase("cc by nc", "cc-by-nc", base=True),
    Phrase("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Phrase("redistribution and use in source and binary forms with or without modification", "bsd"),
    Phrase("gnu general public license version 2", "gpl-2"), Phrase("gnu general public license version 3", "gpl-3"), Phrase("gnu general public license v2", "gpl-2"), Phrase("gnu general public license v3", "gpl-3"),
    Phrase("gnu lesser general public license", "lgpl"), Phrase("gnu affero general public license", "agpl"), Phrase("mozilla public license", "mpl"), Phrase("eclipse public license", "epl"),
    Phrase("creative commons attribution noncommercial", "cc-by-nc"), Phrase("creative commons attribution non commercial", "cc-by-nc"),
    Phrase("creative commons attribution sharealike", "cc-by-sa"), Phrase("creative commons attribution share alike", "cc-by-sa"), Phrase("cc by sa", "cc-by-sa"), Phrase("cc by 4", "cc-by"), Phrase("creative commons attribution", "cc-by"),
    Phrase("free and unencumbered software released into the public domain", "unlicense"),
    Phrase("mit license", "mit", 0.6), Phrase("apache license", "apache", 0.6), Phrase("bsd license", "bsd", 0.6), Phrase("gnu general public license", "gpl", 0.6), Phrase("cc0", "cc0", 0.6),
    Phrase("all rights reserved", "proprietary", 0.6), Phrase("public domain", "public-domain", 0.6),
    Phrase("spdx license identifier", None), Phrase("license expression", None), Phrase("license", None), Phrase("licence", None),
)
#: Licence names in expressions with their labels (a trailing + or -only, -or-later, is left out first).
NAMES = {
    "mit": "mit", "isc": "isc", "apache-2.0": "apache-2", "apache-1.1": "apache", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "0bsd": "bsd", "zlib": "zlib", "unlicense": "unlicense", "cc0-1.0": "cc0",
    "cc-by-4.0": "cc-by", "cc-by-3.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-sa-3.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc", "cc-by-nc-nd-4.0": "cc-by-nc",
    "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl", "mpl-2.0": "mpl", "epl-1.0": "epl", "epl-2.0": "epl",
}
#: Terms from free to strict, how free each leaves a reader, and the labels of each; names that are not listed are unknown.
TERMS = ("permissive", "weak copyleft", "copyleft", "unknown", "noncommercial", "proprietary")
FREEDOM = dict(zip(TERMS, (1.0, 0.75, 0.5, 0.25, 0.1, 0.0)))
OF_LABEL = {"lgpl": "weak copyleft", "mpl": "weak copyleft", "epl": "weak copyleft", "gpl": "copyleft", "gpl-2": "copyleft", "gpl-3": "copyleft", "agpl": "copyleft", "cc-by-sa": "copyleft", "cc-by-nc": "noncommercial", "proprietary": "proprietary"}
#: Bytes that the automaton goes over at once.
PIECE = 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_COLON = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_LATER = re.compile(r"(?:\+|-only|-or-later)$")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Licence:
    """What an expression comes to: its spelling in brackets, its labels, and the place of its terms in TERMS."""

    spelled: str
    labels: frozenset[str]
    terms: int


def of_name(name: str) -> Licence:
    label = NAMES.get(_LATER.sub("", name))
    return Licence(name, frozenset([label] if label else []), TERMS.index(OF_LABEL.get(label, "permissive") if label else "unknown"))


def applied(operator: str, a: Licence, b: Licence) -> Licence:
    spelled = f"({a.spelled} {operator} {b.spelled})"
    if operator == "with":  # an exception is no licence of its own
        return Licence(spelled, a.labels, TERMS.index("weak copyleft") if TERMS[a.terms] == "copyleft" else a.terms)
    return Licence(spelled, a.labels | b.labels, (min if operator == "or" else max)(a.terms, b.terms))


def evaluated(text: bytes, at: int = 0) -> Licence | None:
    """The licence expression of lower-case ``text`` at ``at``, by two stacks; None if it is none.

    It ends with the line, or where a name is followed by neither an operator nor a bracket that closes. Operators that have nothing to
    stand between, or a bracket without its other, make it none.
    """
    values: list[Licence] = []
    operators: list[str] = []
    operand = True  # whether a name or an opening bracket has to come next

    def reduce() -> None:
        b, a = values.pop(), values.pop()
        values.append(applied(operators.pop(), a, b))

    while m := _TOKEN.match(text, at):
        spelled = m[1].decode()
        token = spelled.rstrip(".:-")
        if operand and token == "(":
            operators.append(token)
        elif operand and token not in _BINDS and token != ")":
            values.append(of_name(token))
            operand = False
            if spelled != token:  # the mark behind it ends the sentence
                at = m.end()
                break
        elif not operand and spelled in _BINDS:
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[token]:
                reduce()
            operators.append(token)
            operand = True
        elif not operand and token == ")" and "(" in operators:
            while operators[-1] != "(":
                reduce()
            operators.pop()
        else:
            break
        at = m.end()
    if operand:
        return None
    while operators:
        if operators[-1] == "(":
            return None
        reduce()
    return values[0]


def automaton(phrases: tuple[Phrase, ...] = PHRASES) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        key = f" {p.words} "
        a.add_word(key, (i, len(key)))
    a.make_automaton()
    return a


def words_of(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(folded bytes, first byte of each word in them, last byte of each word): A-Z lowered, all that is no word blank."""
    folded = (text or "").encode("utf-8", "replace").translate(_FOLD)
    inside = np.concatenate([[False], np.frombuffer(folded, np.uint8) != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return folded, edge[::2], edge[1::2] - 1


def places(a: ahocorasick.Automaton, folded: bytes, starts: np.ndarray, ends: np.ndarray, piece: int = PIECE) -> list[tuple[int, int]]:
    """(phrase, number of its first word) of every place, piece by piece; pieces lap over by the longest phrase."""
    if not len(starts):
        return []
    b = np.frombuffer(folded, np.uint8)
    keep = b != 32
    keep[ends[ends + 1 < len(b)] + 1] = True  # the blank behind each word stays
    spaced = b" " + b[keep].tobytes().strip(b" ") + b" "
    lap = max(length for _, length in a.values())
    out, blanks = [], None
    for at in range(0, len(spaced), piece):
        for end, (i, length) in a.iter(spaced[at : at + piece + lap].decode("latin-1")):
            first = end - length + 1
            if first < piece:
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
                out.append((i, int(np.searchsorted(blanks, at + first))))
    return out


def findings(a: ahocorasick.Automaton, text: str | None, phrases: tuple[Phrase, ...] = PHRASES) -> dict:
    """One document's columns."""
    folded, starts, ends = words_of(text)
    found = sorted({(w, -phrases[i].words.count(" "), i) for i, w in places(a, folded, starts, ends)})
    base, labels, certainty, terms, spelled, covered = [], set(), 0.0, [], [], 0
    raw = None
    for w, more, i in found:
        p = phrases[i]
        if p.label is None:
            # The tag's colon and expression are marks, so they are read from the text itself.
            raw = raw if raw is not None else (text or "").encode("utf-8", "replace").lower()
            colon = _COLON.match(raw, int(ends[w - more]) + 1)
            e = evaluated(raw, colon.end()) if colon else None
            if e and e.labels:
                labels |= e.labels
                certainty = 1.0
                terms.append(e.terms)
                spelled.append(e.spelled)
            continue
        if p.base:
            base.append((w, p.label))
        elif w - more < covered:  # inside a longer notice
            continue
        covered = max(covered, w - more + 1)
        labels.add(p.label)
        certainty = max(certainty, p.certainty)
        terms.append(TERMS.index(OF_LABEL.get(p.label, "permissive")))
    return {
        "n_words": len(starts), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted(labels)), "score": certainty,
        "terms": TERMS[max(terms)] if terms else None, "freedom": FREEDOM[TERMS[max(terms)]] if terms else None, "expressions": "; ".join(spelled),
    }


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, terms string, freedom double, expressions string"


def licences(docs: DataFrame, phrases: tuple[Phrase, ...] = PHRASES) -> DataFrame:
    """(doc_id, words, places and labels of base phrases, all labels, score, terms, freedom, expressions) per document of ``docs(doc_id, text)``.

    score is the certainty that the text states a licence: 1 behind an identifier tag, 0.9 for a notice, 0.6 for a licence's name alone, else 0.
    terms are the strictest of all findings, since they hold together, and freedom puts them between 0 and 1; both are null without one. A phrase
    that stands inside a longer one says nothing of its own unless it is a base phrase. Null and empty texts have no words; texts of any length are
    read whole; rows that repeat are scanned alike; other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")

    def run(batches):
        a = automaton(phrases)
        for b in batches:
            rows = [findings(a, t, phrases) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[n] for r in rows], k) for n, k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *[n for n, _ in kinds]])

    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    kinds = [(n, arrow[k]) for n, k in (x.split() for x in _FOUND.split(", "))]
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
