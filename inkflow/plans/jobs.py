"""Whole jobs: token shards from documents, windows for training, and a vocabulary from weighted sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.functions import encode, text
from inkflow.operators import wordfreq
from inkflow.plans import sequence
from inkflow.sources import mix, readers, shards


def placed(docs: DataFrame, codes: list[tuple[str, str]] = (), words: list[str] = (), freq: dict[str, int] | None = None, keep: float = 0.5, script: tuple[dict[str, str], ...] = (), seed: int = 67) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, start, ids): cleaned, converted (by the stages of ``script``), normalised, encoded, framed and placed.

    Where the number of ids is not known without them they are made twice: only that number goes through the prefix sum.
    """
    ready = text.nfkc(text.script_converter(*script)(text.clean(F.col("text"))))
    d = docs.select("doc_id", ready.alias("text"))
    e = encode.encoder(codes, words, freq, keep, seed)
    ids = encode.framed(e(F.col("doc_id").cast("string"), F.col("text")))
    size = F.size(ids) if codes or words else encode.n_tokens(F.col("text"))
    return readers.spread(sequence.prefix_sum(d, "doc_id", size, "start"), "start").select("doc_id", "start", ids.alias("ids"))


def build_shards(docs: DataFrame, path: str, per_shard: int, block: int = sequence.BLOCK, most: int | None = None, source: str | None = None, mode: str = "include", settings: dict | None = None, **encoding) -> dict:
    """Shards of ``docs(doc_id, text, source)`` below ``path``; a run that finds shards there goes on after their rows.

    The manifest holds what the shards were made from, and a run with other settings is an error. A last shard that was
    cut short stays so; the next one starts after it. With ``most`` rows written there is nothing left to do.
    """
    spark = docs.sparkSession
    made_from = {"source": source, "mode": mode, **(settings or {})}
    before = shards.resume(spark, path, per_shard, block, made_from)
    done = before["rows_written"] if before else 0
    if before and most is not None and done >= most:
        return before
    d = placed(readers.filtered_or_error(docs, source, mode), **encoding)
    if done:
        rest = F.greatest(F.lit(0), F.lit(done) - F.col("start")).cast("int")
        d = d.where(F.col("start") + F.size("ids") > done).select(F.greatest(F.lit(0), F.col("start") - done).cast("long").alias("start"), F.slice("ids", rest + 1, F.size("ids")).alias("ids"))
        if d.isEmpty():
            return before
    return shards.write_shards(d.select("start", "ids"), path, per_shard, block, made_from, len(before["shards"]) if before else 0, None if most is None else most - done, most)


def training_split(spark: SparkSession, path: str, held_out: int = 4, block: int = sequence.BLOCK, stride: int = sequence.STRIDE) -> tuple[DataFrame, DataFrame | None]:
    """Windows of all shards but the last ones, and of those; a single shard leaves nothing to hold out."""
    n = len(shards.read_json(spark, f"{path}/manifest.json")["shards"])
    k = sequence.validation_shards(n, held_out)
    train = shards.read_shards(spark, path, 0, n - k, block, stride)
    return train, shards.read_shards(spark, path, n - k, None, block, stride) if k else None


def build_vocabulary(docs: DataFrame, weights: dict[str, float], freq: dict[str, int], sample: int = mix.SAMPLE, k: int = wordfreq.TOP, script: tuple[dict[str, str], ...] = (), hidden: text.HiddenStates | None = None) -> DataFrame:
    """(word, n): the most frequent vocabulary words of a sample that takes each source by its weight; no source at all is an error."""
    spark = docs.sparkSession
    quota = mix.sample_quota(spark, weights, sample)
    order = mix.mix_weights(spark, weights).select("source", F.col("ord").alias("source_ord"))
    chosen = readers.per_source_first(docs.select("doc_id", "text", "source"), quota)
    wordfreq.loaded_sources(chosen)
    ready = text.script_converter(*script)(text.nfkc(F.coalesce("text", F.lit(""))))
    words = text.segmenter(freq, hidden)(ready)
    return wordfreq.top_words(wordfreq.word_counts(chosen.join(F.broadcast(order), "source").select("source_ord", "doc_id", words.alias("words"))), k)
