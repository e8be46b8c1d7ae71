"""Reading documents, in batch and as a stream, and filters by source."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.plans.sequence import prefix_sum

SCHEMA = "doc_id long, text string, source string"


def read_documents(spark: SparkSession, json_path: str | None = None, mix: list[dict] | None = None, path: str | None = None, files: str | None = None, split: str | None = None, streaming: bool = False, schema: str = SCHEMA) -> DataFrame:
    """JSON wins over a mix, and that over one path.

    ``split`` is a partition folder below the path, ``files`` a name pattern. A stream needs the schema, a batch finds its own.
    A mix is a list of dicts with name, weight, path, files and split; missing columns become null. As a batch it comes interleaved; as a stream
    it is the sources' rows with mix_name, which ``streaming.mix.interleave_to_parquet`` puts in the order of the mix as they arrive.
    """
    if json_path:
        return spark.readStream.schema(schema).json(json_path) if streaming else spark.read.json(json_path)
    if mix:
        from inkflow.sources.mix import interleave, mix_weights

        mix_weights(spark, {m["name"]: float(m.get("weight", 1.0)) for m in mix})
        parts = [read_documents(spark, path=m["path"], files=m.get("files"), split=m.get("split", split), streaming=streaming, schema=schema).withColumn("mix_name", F.lit(m["name"])) for m in mix]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p, allowMissingColumns=True)
        if streaming:
            return union
        return interleave(union, {m["name"]: float(m.get("weight", 1.0)) for m in mix}, source="mix_name")
    if not path:
        raise ValueError("nothing to read")
    path = f"{path}/{split}" if split else path
    reader = spark.readStream.schema(schema) if streaming else spark.read
    reader = reader.option("pathGlobFilter", files) if files else reader
    return reader.json(path) if (files or path).endswith((".json", ".jsonl", ".json.gz")) else reader.parquet(path)


def spread(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Dealt by id to all cores where the files make fewer parts than there are cores; else as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, order) if docs.rdd.getNumPartitions() < cores else docs


def _chosen(source: str, mode: str) -> Column:
    if mode not in ("include", "exclude"):
        raise ValueError(f"mode {mode!r}: include or exclude")
    same = F.col("source").eqNullSafe(F.lit(source))
    return same if mode == "include" else ~same


def by_source(docs: DataFrame, source: str | None, mode: str = "include") -> DataFrame:
    """Rows of one source, or of all others (those of no source too); no source, no filter."""
    chosen = _chosen(source, mode)
    return docs.where(chosen) if source else docs


def filter_audit(docs: DataFrame, source: str, mode: str = "include") -> DataFrame:
    """One row: rows before and after the filter."""
    return docs.agg(F.count(F.lit(1)).alias("before"), F.count_if(_chosen(source, mode)).alias("after"))


def filtered_or_error(docs: DataFrame, source: str | None, mode: str = "include") -> DataFrame:
    """The filter for batches, where no row left is an error; a stream goes on without."""
    out = by_source(docs, source, mode)
    if not out.isStreaming and source and out.isEmpty():
        raise ValueError(f"no rows left: {mode} {source!r}")
    return out


def source_list(docs: DataFrame) -> DataFrame:
    return docs.where("source is not null").select(F.col("source").cast("string")).distinct().orderBy("source")


def first_row(docs: DataFrame) -> DataFrame:
    return docs.limit(1)


def numbered(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Adds pos: the place in the order, from 0."""
    return prefix_sum(docs, order, F.lit(1), "pos")


def micro_batches(docs: DataFrame, size: int = 1024, order: str = "doc_id") -> DataFrame:
    """Adds batch_id: consecutive rows in groups of ``size``, the last as it comes; null texts become empty."""
    return numbered(docs.withColumn("text", F.coalesce("text", F.lit(""))), order).withColumn("batch_id", F.floor(F.col("pos") / size)).drop("pos")


def rows_from(docs: DataFrame, skip: int = 0, most: int | None = None, order: str = "doc_id") -> DataFrame:
    """A resumed and capped scan: rows from the ``skip``-th on, up to the ``most``-th of all."""
    d = numbered(docs, order).where(F.col("pos") >= skip)
    return d.where(F.col("pos") < most) if most is not None else d


def worker(docs: DataFrame, workers: int, order: str = "doc_id") -> DataFrame:
    """Adds worker: rows dealt in turn."""
    return numbered(docs, order).withColumn("worker", F.pmod("pos", F.lit(workers)).cast("int")).drop("pos")


def hash_unit(seed: int, key: Column) -> Column:
    """A reproducible number in [0, 1) from 32 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296


def shuffled(docs: DataFrame, seed: int = 67, epoch: int = 0, worker: int = 0, buffer: int | None = None, order: str = "doc_id") -> DataFrame:
    """Adds shuffle_key, a reproducible order for seed + epoch + worker: of all rows, or within blocks of ``buffer``."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed + epoch + worker)), F.col(order).cast("string")))
    if buffer is None:
        return docs.withColumn("shuffle_key", key)
    d = numbered(docs, order)
    return d.withColumn("shuffle_key", F.concat_ws(":", F.lpad(F.floor(F.col("pos") / buffer).cast("string"), 12, "0"), key)).drop("pos")


def minibatches(windows: DataFrame, size: int = 128) -> DataFrame:
    """Adds batch_id and its row: windows in their order, none dropped."""
    return windows.withColumns({"batch_id": F.floor(F.col("window_id") / size), "row": F.pmod("window_id", F.lit(size))})


def collated(batches: DataFrame) -> DataFrame:
    """(batch_id, xs, targets): the windows of each batch, stacked in order."""
    rows = F.array_sort(F.collect_list(F.struct("window_id", "x", "target")))
    return batches.groupBy("batch_id").agg(rows.alias("rows")).select("batch_id", F.transform("rows", lambda r: r["x"]).alias("xs"), F.transform("rows", lambda r: r["target"]).alias("targets"))


def per_source_first(docs: DataFrame, quota: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first rows of each source, as many as ``quota(source, quota)`` says."""
    ranked = prefix_sum(docs.where("source is not null"), order, F.lit(1), "rank", by=("source",))
    return ranked.join(quota, "source").where("rank < quota").drop("quota")




def _whole(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, char, code) from a JSON object of codes by character, in its order."""
    return spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(_whole(spark, path).items())], "ord int, char string, code string")


def read_words(spark: SparkSession, path: str) -> list[str]:
    """Words of the direct vocabulary from a JSON list; one that is there twice is an error."""
    words = _whole(spark, path)
    if len(set(words)) != len(words):
        raise ValueError(f"{path} holds a word twice")
    return words
