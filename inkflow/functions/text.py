"""Text cleaning and character predicates."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.functions.batches import arrow_function

#: Remnants of numbered escapes; an escape of digit 0 stays.
ESCAPE = r"\\[1-9][0-9]*"
#: Code point ranges of CJK characters; the second is the basic block.
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
WORD_MOST = 4


def clean(text: Column) -> Column:
    """Null becomes empty; each escape remnant becomes one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, " ")


def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t).replace("　", " ") for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """NFKC, with ideographic spaces as blanks; null stays null."""
    return arrow_function(_nfkc, "string")(text)


class Trie:
    """Entries by their characters. The longest entry at a place costs its own length, however many entries there are."""

    def __init__(self, table: dict[str, str]):
        self.root: dict = {}
        for entry, value in table.items():
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            if entry:
                node[""] = value
        first = "".join(map(re.escape, (c for c in self.root if c)))
        self.first = re.compile(f"[{first}]") if first else None

    def rewrite(self, text: str) -> str:
        """From left to right, the longest entry at each place is replaced by its value; what is replaced is not looked at again."""
        out, done = [], 0
        found = self.first.search(text) if self.first else None
        while found:
            at = end = found.start()
            node, value = self.root, None
            while end < len(text) and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    stop, value = end, node[""]
            if value is None:
                stop = at + 1
            else:
                out += text[done:at], value
                done = stop
            found = self.first.search(text, stop)
        return "".join([*out, text[done:]])


def script_converter(*stages: dict[str, str]):
    """A function of a text column that rewrites it stage by stage (phrases, then regional words, then variants), each by its own table.

    A stage sees what the one before made. Empty tables change nothing; null stays null.
    """
    used = [t for t in stages if t]
    if not used:
        return lambda text: text
    held: list[Trie] = []

    def convert(text: pa.Array) -> pa.Array:
        if not held:  # once for a task
            held.extend(map(Trie, used))

        def one(t: str) -> str:
            for trie in held:
                t = trie.rewrite(t)
            return t

        return pa.array([None if t is None else one(t) for t in text.to_pylist()], pa.string())

    return arrow_function(convert, "string")


def best_path(text: str, freq: dict[str, int], longest: int, total: int) -> list[str]:
    """Words of the segmentation with the largest product of frequencies; an unknown character counts once."""
    floor = math.log(total or 1)
    best: list[tuple[float, int]] = [(0.0, 0)] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        ways = [(math.log(freq.get(text[i:j], 0) or 1) - floor + best[j][0], j) for j in range(i + 1, min(len(text), i + longest) + 1) if j == i + 1 or freq.get(text[i:j], 0) > 0]
        best[i] = max(ways)
    out, i = [], 0
    while i < len(text):
        out.append(text[i : best[i][1]])
        i = best[i][1]
    return out


#: States of a character in a word: it begins one, stands in the middle, ends one, or is one; and those that may come before each.
BEGIN, MIDDLE, END, SINGLE = STATES = "BMES"
COMES_AFTER = {BEGIN: END + SINGLE, MIDDLE: MIDDLE + BEGIN, END: BEGIN + MIDDLE, SINGLE: SINGLE + END}
#: Logarithm that stands for what the tables have not seen.
UNSEEN = -1e9


@dataclass(frozen=True)
class HiddenStates:
    """Logarithms: of the first state, of a state after another, and of a character in a state."""

    start: dict[str, float]
    step: dict[tuple[str, str], float]
    emit: dict[tuple[str, str], float]

    def words(self, text: str) -> list[str]:
        """The words of the most probable states; a text ends with a word. Of equal ones the state that is later in STATES wins."""
        if not text:
            return []
        likely = {s: self.start.get(s, UNSEEN) + self.emit.get((s, text[0]), UNSEEN) for s in STATES}
        chosen: list[dict[str, str]] = []
        for c in text[1:]:
            before, came = likely, {}
            likely = {}
            for s in STATES:
                best, came[s] = max((before[p] + self.step.get((p, s), UNSEEN), p) for p in COMES_AFTER[s])
                likely[s] = best + self.emit.get((s, c), UNSEEN)
            chosen.append(came)
        state = max(END + SINGLE, key=lambda s: (likely[s], s))
        states = [state]
        for came in reversed(chosen):
            states.append(state := came[state])
        out, at = [], 0
        for i, s in enumerate(reversed(states), 1):
            if s in END + SINGLE:
                out.append(text[at:i])
                at = i
        return out


def hidden_states(words: DataFrame) -> HiddenStates:
    """The tables from ``words(word, freq)``, counted as sequences of words: how often a character stands at each place of a word.

    A word of one character is in the state of its own. One word follows another independently. The tables hold a row for each
    character and state, which the alphabet bounds.
    """
    w = words.where((F.col("freq") > 0) & (F.char_length("word") > 0)).select(F.filter(F.split("word", ""), lambda c: c != "").alias("cs"), F.col("freq").cast("double").alias("freq"))
    place = lambda c, i: F.when(F.size("cs") == 1, SINGLE).when(i == 0, BEGIN).when(i == F.size("cs") - 1, END).otherwise(MIDDLE)
    each = w.select(F.explode(F.transform("cs", lambda c, i: F.struct(place(c, i).alias("state"), c.alias("char")))).alias("x"), "freq")
    counts = {(r["state"], r["char"]): r["n"] for r in each.groupBy("x.state", "x.char").agg(F.sum("freq").alias("n")).collect()}
    total = {s: sum(n for (t, _), n in counts.items() if t == s) for s in STATES}
    log = lambda x, of: math.log(x / of) if x and of else UNSEEN
    start = {BEGIN: log(total[BEGIN], total[BEGIN] + total[SINGLE]), SINGLE: log(total[SINGLE], total[BEGIN] + total[SINGLE]), MIDDLE: UNSEEN, END: UNSEEN}
    inner = total[BEGIN] + total[MIDDLE]  # each is followed by a middle or an end, in all as many as there are of these
    step = {(p, s): start[s] if s in BEGIN + SINGLE else log(total[s], inner) for s, before in COMES_AFTER.items() for p in before}
    return HiddenStates(start, step, {k: log(n, total[k[0]]) for k, n in counts.items()})


def _with_unknown(path: list[str], freq: dict[str, int], hidden: HiddenStates) -> list[str]:
    """Single characters that stand together on the path, and are no word together, are cut by hidden states."""
    out, run = [], []
    for w in [*path, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        if run:
            together = "".join(run)
            out += run if len(run) == 1 or freq.get(together, 0) > 0 else hidden.words(together)
            run = []
        out += [w] if w else []
    return out


def segmenter(freq: dict[str, int], hidden: HiddenStates | None = None):
    """A function of a text column that gives its words: by frequency for CJK runs, else runs of word characters and single ones.

    With ``hidden`` words that the dictionary lacks are found by the places of their characters; without, they fall into single ones.
    """
    longest, total = max(map(len, freq), default=1), sum(freq.values())
    piece = re.compile(r"[㐀-䶿一-鿿豈-﫿]+|[^\W㐀-䶿一-鿿豈-﫿]+|[\s\S]")

    def cut(p: str) -> list[str]:
        if not any(low <= ord(p[0]) <= high for low, high in CJK):
            return [p]
        path = best_path(p, freq, longest, total)
        return _with_unknown(path, freq, hidden) if hidden else path

    def words(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [w for p in piece.findall(t) for w in cut(p)] for t in text.to_pylist()], pa.list_(pa.string()))

    return arrow_function(words, "array<string>")


def _in(c: Column, ranges) -> Column:
    code = F.ascii(c)  # the whole code point
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | code.between(low, high)
    return (F.char_length(c) == 1) & inside


def is_cjk(c: Column) -> Column:
    return _in(c, CJK)


def is_basic_cjk(c: Column) -> Column:
    return _in(c, CJK[1:2])


def is_cjk_word(w: Column, most: int = WORD_MOST) -> Column:
    return F.char_length(w).between(2, most) & F.forall(F.filter(F.split(w, ""), lambda c: c != ""), is_cjk)


def _numeric_class() -> str:
    """A character class of everything with a numeric value, as ranges."""
    out, start = [], None
    for c in range(0x110001):
        numeric = c < 0x110000 and not 0xD800 <= c <= 0xDFFF and chr(c).isnumeric()
        if numeric and start is None:
            start = c
        elif not numeric and start is not None:
            out.append(f"\\x{{{start:x}}}-\\x{{{c - 1:x}}}")
            start = None
    return "[" + "".join(out) + "]"


NUMERIC = _numeric_class()


def is_vocabulary_word(w: Column) -> Column:
    """Two or more characters, not a number in any script, and not beginning in ASCII."""
    return (F.char_length(w) >= 2) & (F.ascii(F.substring(w, 1, 1)) > 127) & ~F.rlike(w, F.lit(f"^{NUMERIC}+$"))


def without_bos(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[BOS\]", "")


def added_text(text: Column, before: Column) -> Column:
    """What ``text`` adds to ``before`` if it extends it, else the whole text."""
    return F.when(F.startswith(text, before), F.substring(text, F.char_length(before) + 1, F.char_length(text))).otherwise(text)


def _utf8_runs(values: pa.Array) -> pa.Array:
    def text(b):
        try:
            return b.decode()
        except UnicodeDecodeError:
            return "�"

    return pa.array([None if b is None else text(b) for b in values.to_pylist()], pa.string())


def utf8_runs(values: Column) -> Column:
    """Bytes of one run as text; a run that is no UTF-8 is one replacement character."""
    return arrow_function(_utf8_runs, "string")(values)
