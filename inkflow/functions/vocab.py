"""Direct tokens, shape codes and output ids.

Direct tokens come in a fixed order: 26 letters of shape codes, four marks, printable ASCII with line feed and tab, the
256 bytes, then the words that a caller gives. Letters are no outputs, so output_id = token_id - 26; each distinct
shape code is one more output, in the order in which the table shows it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = [f"cj_{chr(97 + i)}" for i in range(26)]
MARKS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]"]
PAD, UNK, BOS, EOS = 26, 27, 28, 29
ROW, FIRST_BYTE = 5, 127


def tokens(words: list[str] = ()) -> list[str]:
    out = [*LETTERS, *MARKS, *map(chr, range(32, 127)), "\n", "\t", *(f"<BYTE_{i}>" for i in range(256)), *words]
    if len({*out}) != len(out):
        raise ValueError("a word is there twice, or is a token already")
    return out


def vocabulary(spark: SparkSession, words: list[str] = ()) -> DataFrame:
    """(token, token_id, output_id); letters have no output_id."""
    rows = [(t, i, i - 26 if i >= 26 else None) for i, t in enumerate(tokens(words))]
    return spark.createDataFrame(rows, "token string, token_id int, output_id int")


def output_id(token_id: Column) -> Column:
    return F.when(token_id >= 26, token_id - 26)


def code_index(codes: DataFrame) -> DataFrame:
    """``codes(ord, char, code)`` -> (code, code_index): distinct codes in the order of their first appearance."""
    first = codes.groupBy("code").agg(F.min("ord").alias("ord"))
    return first.select("code", (F.row_number().over(Window.orderBy("ord")) - 1).alias("code_index"))


def code_candidates(codes: DataFrame) -> DataFrame:
    """(code, chars): the characters of each code in the order of the table."""
    return codes.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "char"))), lambda x: x["char"]).alias("chars"))


def code_row(code: Column) -> Column:
    """A code's letters as token ids, padded to five; a longer code is an error."""
    letters = F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: F.ascii(c) - 97)
    padded = F.slice(F.concat(letters, F.array_repeat(F.lit(PAD), ROW)), 1, ROW)
    return F.when(F.char_length(code) <= ROW, padded).otherwise(F.raise_error(F.concat(F.lit("code of more than five letters: "), code)))


def direct_row(token_id: Column) -> Column:
    return F.concat(F.array(token_id.cast("int")), F.array_repeat(F.lit(PAD), ROW - 1))


def output_vocabulary(spark: SparkSession, codes: DataFrame | None = None, words: list[str] = ()) -> DataFrame:
    """(output_id, row, label): direct outputs, then one per distinct code."""
    v = vocabulary(spark, words)
    out = v.where("output_id is not null").select("output_id", direct_row(F.col("token_id")).alias("row"), F.col("token").alias("label"))
    if codes is None:
        return out
    first = len(tokens(words)) - 26
    return out.union(code_index(codes).select((F.col("code_index") + first).cast("int"), code_row(F.col("code")), "code"))


def pack(row: Column) -> Column:
    """Five ids, nine bits each, as one integer; only the first may exceed its field, so keys stay unique."""
    fits = F.forall(F.slice(row, 2, ROW - 1), lambda x: x < 512)
    key = F.shiftleft(row[0].cast("long"), 36)
    for i in range(1, ROW):
        key = key.bitwiseOR(F.shiftleft(row[i].cast("long"), 9 * (ROW - 1 - i)))
    return F.when(fits, key).otherwise(F.raise_error(F.lit("an id after the first needs more than nine bits")))


def is_letter_row(row: Column) -> Column:
    return row[0].between(0, 25)


#: Rows of an output vocabulary that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def to_output_ids(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """Adds output_id to ``rows(row, ..)``; a row that is no output is an error."""
    keyed = outputs.select(pack(F.col("row")).alias("_key"), F.col("output_id"))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed
    found = rows.withColumn("_k", pack(F.col("row"))).join(keyed, F.col("_k") == F.col("_key"), "left")
    checked = F.coalesce("output_id", F.raise_error(F.lit("row without an output")).cast("int"))
    return found.withColumn("output_id", checked).drop("_k", "_key")


def fingerprint(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: SHA-256 of the values in order, joined by line feeds."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")
    return df.agg(F.sha2(joined, 256).alias("fingerprint"))


def slot_targets(row: Column) -> Column:
    """A letter row is its own target, slot by slot (padding is class 26); any other has nothing to learn in its slots."""
    return F.when(row[0] <= 25, row).otherwise(F.array_repeat(F.lit(-100), ROW))
