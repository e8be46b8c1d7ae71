"""Token shards as a data source of their own: ``spark.read.format("token_shards")`` and ``df.write.format("token_shards")``.

A shard is one file, and the manifest says which files there are. Each shard is one partition of a read, opened in its task and no sooner, whose
windows are cut while its ids stream by: no shuffle, and only the rest of a block is held. Filters on shard_id leave partitions out before any is opened.
A write makes files that nobody sees; its commit puts a new manifest in place of the old one, and its abort removes the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from inkflow.plans.sequence import BLOCK, STRIDE, sharded
from inkflow.sources.shards import canonical

NAME, FORMAT, MANIFEST = "token_shards", 2, "shards.json"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "shard_id long, window_id long, x array<int>, target array<int>"
#: Rows of documents' ids that are read from a file at once, and windows in a batch.
ROWS, WINDOWS = 256, 1024
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of any address that Arrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict | None:
    store, at = _store(path)
    if store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Shard(InputPartition):
    shard_id: int
    file: str


class ShardReader(DataSourceReader):
    def __init__(self, path: str, block: int, stride: int):
        if stride > block:
            raise ValueError("a stride above the block would lose what lies between windows")
        self.path, self.block, self.stride, self.tests = path, block, stride, []

    def partitions(self) -> list[Shard]:
        m = read_manifest(self.path)
        if m is None or m["format_version"] != FORMAT or m["block_size"] != self.block:
            raise ValueError(f"{self.path} holds no shards of this format and block")
        return [Shard(s["shard_id"], s["file"]) for s in m["shards"] if all(_TESTS[kind](s["shard_id"], value) for kind, value in self.tests)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        store, at = _store(self.path)
        held, first = np.zeros(0, np.int32), 0
        with store.open_input_file(f"{at}/{partition.file}") as f:
            for b in pq.ParquetFile(f).iter_batches(ROWS, columns=["ids"]):
                held = np.concatenate([held, b.column(0).flatten().to_numpy()])
                count = max(0, (len(held) - self.block - 1) // self.stride + 1)
                for low in range(0, count, WINDOWS):
                    yield self._batch(partition.shard_id, first + low, held[low * self.stride :], min(WINDOWS, count - low))
                held, first = held[count * self.stride :], first + count

    def _batch(self, shard_id: int, first: int, ids: np.ndarray, n: int) -> pa.RecordBatch:
        def lists(v: np.ndarray) -> pa.ListArray:
            cut = np.lib.stride_tricks.sliding_window_view(v, self.block)[:: self.stride][:n]
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.block, pa.int32()), pa.array(cut.ravel(), pa.int32()))

        return pa.RecordBatch.from_arrays([pa.array([shard_id] * n, pa.int64()), pa.array(np.arange(first, first + n)), lists(ids), lists(ids[1:])], ["shard_id", "window_id", "x", "target"])


class FilteringShardReader(ShardReader):
    """The same where Spark hands filters over; Spark refuses such a reader where it does not."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("shard_id",):
                self.tests.append((type(f), f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class ShardWriter(DataSourceArrowWriter):
    """Rows of (shard_id, start, ids), those of a shard together and in order of start."""

    def __init__(self, path: str, overwrite: bool, settings: dict):
        self.path, self.overwrite, self.settings = path, overwrite, settings

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.path)
        store.create_dir(f"{at}/files", recursive=True)
        schema, out, done = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int32()))]), None, []
        for b in iterator:
            shard, start, ids = (b.column(n) for n in ("shard_id", "start", "ids"))
            shard, lengths = shard.to_numpy(zero_copy_only=False), pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for low, high in zip(borders, borders[1:]):
                if low == high:
                    continue
                if not done or done[-1]["shard_id"] != shard[low]:
                    if out:
                        out.close()
                    done.append({"shard_id": int(shard[low]), "rows": 0, "file": f"files/{shard[low]}-{uuid.uuid4().hex}.parquet"})
                    out = pq.ParquetWriter(store.open_output_stream(f"{at}/{done[-1]['file']}"), schema)
                ends = done[-1]["rows"] + np.cumsum(lengths[low:high])
                if (start.to_numpy()[low:high] != np.concatenate([[done[-1]["rows"]], ends[:-1]])).any():
                    raise ValueError(f"shard {shard[low]}: ids do not begin where those before end")
                done[-1]["rows"] = int(ends[-1])
                out.write_table(pa.table([start.slice(low, high - low).cast(pa.int64()), ids.slice(low, high - low).cast(pa.list_(pa.int32()))], schema=schema))
        if out:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        before = None if self.overwrite else read_manifest(self.path)
        made = sorted([s for m in messages if m for s in m.shards], key=lambda s: s["shard_id"])
        shards = [*(before["shards"] if before else ()), *made]
        if [s["shard_id"] for s in shards] != list(range(len(shards))):
            raise ValueError("shards must follow each other, and each be written by one task")
        if any(s["rows"] != self.settings["rows_per_shard"] for s in made[:-1]):
            raise ValueError("only the last shard may be short")
        manifest = {"format_version": FORMAT, **self.settings, "rows_written": sum(s["rows"] for s in shards), "shards": shards}
        beside = f"{at}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as f:
            f.write(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode())
        store.move(beside, f"{at}/{MANIFEST}")
        if self.overwrite:  # what older manifests, or runs without one, have left
            used = {s["file"] for s in shards}
            for x in store.get_file_info(fs.FileSelector(f"{at}/files")):
                if f"files/{x.base_name}" not in used:
                    store.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        for s in [s for m in messages if m for s in m.shards]:
            if store.get_file_info(f"{at}/{s['file']}").type != fs.FileType.NotFound:
                store.delete_file(f"{at}/{s['file']}")


class TokenShards(DataSource):
    """Options of a read: path, block, stride, pushdown (whether the session hands filters over). Of a write: path, block, rows_per_shard, source (JSON of what the shards are made from)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        kind = FilteringShardReader if self.options.get("pushdown", "false") == "true" else ShardReader
        return kind(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("stride", STRIDE)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        settings = {"block_size": int(self.options.get("block", BLOCK)), "rows_per_shard": int(self.options["rows_per_shard"]), "source": json.loads(self.options.get("source", "{}"))}
        return ShardWriter(self.options["path"], overwrite, settings)


def write_source(docs: DataFrame, path: str, rows_per_shard: int, block: int = BLOCK, source: dict | None = None, append: bool = False) -> dict:
    """Writes ``docs(start, ids)`` as shards, or adds them as new ones after those that are there, and gives the manifest.

    A shard is written by one task. Shards of other settings can't be added to.
    """
    before = read_manifest(path) if append else None
    made_from = canonical(source or {})
    for key, want in (("format_version", FORMAT), ("block_size", block), ("rows_per_shard", rows_per_shard), ("source", made_from)) if before else ():
        if before[key] != want:
            raise ValueError(f"{path} was written with {key} {before[key]!r}, not {want!r}")
    docs.sparkSession.dataSource.register(TokenShards)
    s = sharded(docs, rows_per_shard).withColumn("shard_id", F.col("shard_id") + (len(before["shards"]) if before else 0))
    s = s.repartition("shard_id").sortWithinPartitions("shard_id", "start").select("shard_id", "start", "ids")
    s.write.format(NAME).option("block", block).option("rows_per_shard", rows_per_shard).option("source", json.dumps(made_from)).mode("append" if append else "overwrite").save(path)
    return read_manifest(path)


def read_source(spark: SparkSession, path: str, block: int = BLOCK, stride: int | None = None) -> DataFrame:
    """(shard_id, window_id, x, target): the windows of all shards, none across a border, side by side if no stride is given.

    Filters on shard_id leave whole shards out where spark.sql.python.filterPushdown.enabled is set; else Spark applies them to the windows.
    """
    spark.dataSource.register(TokenShards)
    return spark.read.format(NAME).option("block", block).option("stride", stride or block).option("pushdown", spark.conf.get(PUSHDOWN)).load(path)
