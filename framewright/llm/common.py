"""Helpers shared by the training-data operators: scratch tables, file access, batches, word hashing."""

from __future__ import annotations

import functools
import os
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the one place that driver and executors share.

    Where that setting is empty a local session (as in tests) uses a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "framewright-scratch")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing reads any more: all that came from them is written itself."""
    for table in tables:
        fs, path = filesystem(table.table_path)
        fs.delete_dir(path)


def sheltered(stage):
    """A stage that keeps all columns of its first table: those that begin with ``__``, as its own do, have other names meanwhile."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = {c: f"sheltered{k}{c}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        return stage(docs.withColumnsRenamed(names), *args, **options).withColumnsRenamed({b: a for a, b in names.items()})

    return run


def filesystem(uri: str):
    """(pyarrow file system, path in it); local, HDFS and object-store URIs alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, blob: bytes) -> None:
    """Write under another name, then rename, so that a task that is lost or repeated leaves no half file."""
    fs, path = filesystem(uri)
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(blob)
    fs.move(part, path)


def batches(iterator, column: str, limit: int = 1 << 20, tokenizing: bool = False):
    """Record batches cut so that ``column`` (string or binary) holds about ``limit`` bytes at most.

    Python workers serve one operator after another: unless ``tokenizing``, the caches that a tokenizing task left
    in this worker are given back first.
    """
    held = sys.modules.get("framewright.llm.tokenizing")
    if held and not tokenizing:
        held.release()
    for batch in iterator:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        if values.null_count == len(values):
            yield batch
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
        part = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)


def blobs(batch: pa.RecordBatch, column: str) -> list:
    """The column's values as UTF-8 bytes; null stays None."""
    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(values.type):
        return [None] * len(values)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every input bit (a multiply-and-shift finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sketch_sums(df: DataFrame, slots: int, dtype=np.int64) -> np.ndarray:
    """Sum of (slot, n) rows as an array of ``slots`` counters: fixed size, whatever the input.

    Rows are summed by Spark; at most ``slots`` sums reach the driver.
    """
    sums = df.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, dtype)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return out


#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ has it.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a fixed odd number modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[start:stop]: prefix sums of a polynomial, so equal spans are equal anywhere."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a column of texts, as arrays over all its rows.

    ``hashes``: a 64-bit hash of each word (A-Z as a-z if ``lower``); ``edges``: words edges[i] .. edges[i + 1] are
    row i's; ``starts``, ``stops``: byte places of each word in ``data``. Null counts as empty.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bounds = at - at[0]
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[self.data], out=word[1:-1])
        cut = np.zeros(n + 1, bool)  # a row begins here
        cut[self.bounds] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        self.stops = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
        self.hashes = span_hashes((_LOWER if lower else _BYTES)[self.data], self.starts, self.stops)
        self.edges = np.searchsorted(self.starts, self.bounds)

    def rows(self):
        """(first word, word after the last) of each row."""
        return zip(self.edges[:-1].tolist(), self.edges[1:].tolist())
