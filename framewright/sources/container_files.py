"""Container files of any size: heads alone, an index of chunk heads, and chunks read by range.

A file's chunks are found by hopping from head to head (a few bytes each), which one task does for a file; the payloads are then read
as ranges that are dealt to all tasks, so no file is ever one value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.octets import HEADER_BYTES, MAGIC, VERSION
from . import ranges

HOP = 1 << 12  # bytes read at a hop; small chunks' heads that lie within need no other
LOT = 1 << 26  # bytes of a file that one task reads at least


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files of a folder (or of one file); their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


class _Window:
    """A file's bytes by place, through one piece of it that is held."""

    def __init__(self, file, step: int):
        self.file, self.step, self.begin, self.data, self.read = file, step, 0, b"", 0

    def get(self, at: int, size: int) -> bytes:
        if not self.begin <= at <= at + size <= self.begin + len(self.data):
            self.begin, self.data = at, self.file.read_at(max(size, self.step), at)
            self.read += len(self.data)
        return self.data[at - self.begin : at - self.begin + size]


def _begin(window: _Window, length: int, limit: int) -> tuple[bytes | None, int, str | None]:
    """(JSON, where chunks begin, error) of a container's header."""
    start = window.get(0, min(length, HEADER_BYTES))
    if len(start) < HEADER_BYTES:
        return None, 0, "header cut short"
    if start[:4] != MAGIC.encode():
        return None, 0, "not a container"
    if start[4] != VERSION:
        return None, 0, "unknown version"
    size = int.from_bytes(start[5:9], "big")
    if HEADER_BYTES + size > length:
        return None, 0, "header cut short"
    if size > limit:
        return None, 0, f"header of over {limit} bytes"
    return window.get(HEADER_BYTES, size), HEADER_BYTES + size, None


def heads(found: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(path, length, json, header_bytes, first_bytes, bytes_read, error) of (path, length): each file's header and the framed size of its first chunk.

    ``bytes_read`` are all that were read of the file: the header and two heads, and never more than ``limit`` and these.
    """
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("json", pa.string()), ("header_bytes", pa.int64()), ("first_bytes", pa.int64()), ("bytes_read", pa.int64()), ("error", pa.string())])

    def run(iterator):
        for batch in iterator:
            rows = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                disk, where = ranges.store(name)
                with disk.open_input_file(where) as file:
                    window = _Window(file, 0)
                    json, begin, error = _begin(window, length, limit)
                    head = window.get(begin, 8) if error is None and begin + 8 <= length else b""
                    rows.append((name, length, json and json.decode(errors="replace"), begin or None, int.from_bytes(head[:4], "big") + 8 if head else None, window.read, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return found.select("path", "length").mapInArrow(run, "path string, length long, json string, header_bytes long, first_bytes long, bytes_read long, error string")


def index(found: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(path, chunk, place, size, crc, error): every chunk's head of (path, length). An error ends a file's rows; its chunk has no size."""
    schema = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("error", pa.string())])

    def walk(name, length):
        disk, where = ranges.store(name)
        with disk.open_input_file(where) as file:
            window = _Window(file, HOP)
            _, at, error = _begin(window, length, limit)
            if error is not None:
                yield name, 0, at, None, None, error
                return
            k = 0
            while at < length:
                if at + 8 > length:
                    yield name, k, at, None, None, "frame cut short"
                    return
                head = window.get(at, 8)
                size = int.from_bytes(head[:4], "big")
                if at + 8 + size > length:
                    yield name, k, at, None, None, "payload cut short"
                    return
                yield name, k, at, size, int.from_bytes(head[4:], "big"), None
                at, k = at + 8 + size, k + 1

    def run(iterator):
        for batch in iterator:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for row in walk(name, length):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return found.select("path", "length").mapInArrow(run, "path string, chunk long, place long, size long, crc long, error string")


def chunks(found: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(path, chunk, place, payload, error) of (path, length): chunks that are ``wanted`` (a condition on the index; all if not given).

    Files are walked by a task each, payloads read where the deal by file and stretch of ``LOT`` bytes puts them.
    """
    rows = index(found)
    rows = rows if wanted is None else rows.where(wanted)
    dealt = rows.repartition("path", F.floor(F.col("place") / LOT)).sortWithinPartitions("path", "place")
    read = ranges.read_at(dealt.withColumns({"at": F.col("place") + 8, "bytes": F.coalesce("size", F.lit(0).cast("long"))}), size="bytes")
    broken = F.coalesce("error", F.when(F.octet_length("data") < F.col("size"), "payload cut short").when(F.crc32("data") != F.col("crc"), "checksum differs"))
    out = read.withColumn("error", broken)
    return out.select("path", "chunk", "place", F.when(F.col("error").isNull(), F.col("data")).alias("payload"), "error")
