"""A sink that streams of framed chunks are written to as container parts, with progress for each batch.

Every task writes one part: the frames of its rows one after the other, and beside it an index of them as Parquet. A batch
counts once its progress file is there, which is written whole under the batch's number; a batch that runs again finds it and throws
its new parts away, so nothing is written twice. The progress files say how many bytes and emissions (rows) there are up to each batch.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import containers

NAME = "container_parts"
_INDEX = pa.schema([("name", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("size", pa.int64())])
_FLUSH = 1 << 22  # bytes held before they are written


def _store(folder: str):
    from pyarrow import fs

    target = "file://" + re.sub(r"^file:/*", "/", folder) if folder.startswith("file:") else folder if "://" in folder else "file://" + os.path.abspath(folder)
    return fs.FileSystem.from_uri(target)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    bytes: int
    emissions: int


class ContainerParts(DataSource):
    """Sink of (name string, chunk long, frame binary); option ``path``: a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite):  # noqa: N802
        if [(f.name, f.dataType.simpleString()) for f in schema.fields] != [("name", "string"), ("chunk", "bigint"), ("frame", "binary")]:
            raise ValueError("container parts are rows (name string, chunk long, frame binary)")
        return _Writer(self.options["path"])


class _Writer(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Part:
        store, path = _store(self.folder)
        store.create_dir(f"{path}/parts", recursive=True)
        name, place, rows, out, held, flushed = uuid.uuid4().hex, 0, [], None, [], 0
        for row in iterator:
            out = out or store.open_output_stream(f"{path}/parts/{name}.bytes")
            frame = bytes(row.frame or b"")
            rows.append((row.name, row.chunk, place, len(frame)))
            held.append(frame)
            place += len(frame)
            if place - flushed >= _FLUSH:
                out.write(b"".join(held))
                held, flushed = [], place
        if out is None:
            return Part(None, 0, 0)
        out.write(b"".join(held))
        out.close()
        with store.open_output_stream(f"{path}/parts/{name}.parquet") as index:
            pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX), index)
        return Part(name, place, len(rows))

    def commit(self, messages, batchId) -> None:  # noqa: N803
        store, path = _store(self.folder)
        parts = [m for m in messages if m is not None and m.name]
        own = f"{path}/progress/{batchId:012d}.json"
        if _there(store, own):
            self._remove(store, path, parts)
            return
        before = _last(store, path)
        line = {
            "batch": batchId, "parts": [m.name for m in parts], "bytes": sum(m.bytes for m in parts), "rows": sum(m.emissions for m in parts),
            "bytes_written": before["bytes_written"] + sum(m.bytes for m in parts), "emissions": before["emissions"] + sum(m.emissions for m in parts),
        }
        store.create_dir(f"{path}/progress", recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(line).encode())
        store.move(part, own)

    def abort(self, messages, batchId) -> None:  # noqa: N803
        store, path = _store(self.folder)
        self._remove(store, path, [m for m in messages if m is not None and m.name])

    def _remove(self, store, path, parts) -> None:
        for m in parts:
            for kind in ("bytes", "parquet"):
                if _there(store, f"{path}/parts/{m.name}.{kind}"):
                    store.delete_file(f"{path}/parts/{m.name}.{kind}")


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _last(store, path: str) -> dict:
    """The progress of the last batch that counts."""
    from pyarrow import fs

    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{path}/progress", allow_not_found=True)) if f.path.endswith(".json"))
    if not found:
        return {"bytes_written": 0, "emissions": 0}
    with store.open_input_stream(found[-1]) as data:
        return json.loads(data.read())


def write(frames: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes in all there is of a stream (name, chunk, frame) and ends; run again, it goes on where the checkpoint is."""
    frames.sparkSession.dataSource.register(ContainerParts)
    rows = frames.select(F.col("name").cast("string").alias("name"), F.col("chunk").cast("long").alias("chunk"), "frame")
    query = rows.writeStream.format(NAME).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, bytes, rows, bytes_written, emissions, parts): a row for each batch that counts; the latter two are sums up to it."""
    schema = "batch long, bytes long, rows long, bytes_written long, emissions long, parts array<string>"
    return spark.read.schema(schema).json(f"{folder}/progress")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(name, chunk, frame) of all batches that count; each task reads its rows' bytes alone."""
    parts = progress(spark, folder).select(F.explode("parts").alias("part"))
    index = spark.read.schema("name string, chunk long, place long, size long").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/parts")
    index = index.withColumn("part", F.regexp_extract(F.input_file_name(), r"([0-9a-f]+)\.parquet$", 1)).join(parts, "part", "left_semi")

    def read(iterator):
        store, path = _store(folder)
        for batch in iterator:
            out, name, file = [], None, None
            for part, place, size in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if part != name:
                    if file:
                        file.close()
                    name, file = part, store.open_input_file(f"{path}/parts/{part}.bytes")
                out.append(file.read_at(size, place))
            if file:
                file.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["name", "chunk", "frame"])

    return index.select("name", "chunk", "part", "place", "size").mapInArrow(read, "name string, chunk long, frame binary")


def joined(spark: SparkSession, folder: str, metadata: Column) -> DataFrame:
    """(name, content): the containers that all batches make together, a header of ``metadata`` before each one's chunks in order."""
    return containers.joined(frames(spark, folder), "name", "chunk", metadata)


def observed(rows: DataFrame, name: str) -> DataFrame:
    """The stream with its emissions and bytes observed under ``name``; :class:`Watch` gathers them."""
    return rows.observe(name, F.count(F.lit(1)).alias("emissions"), F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).alias("bytes"))


class Watch(StreamingQueryListener):
    """Sums of the observed metrics of a name while the job runs: batches, emissions, bytes."""

    def __init__(self, name: str):
        self.name, self.seen = name, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        own = event.progress.observedMetrics.get(self.name)
        if own is not None:
            self.seen[event.progress.batchId] = (own.emissions, own.bytes)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> tuple[int, int]:
        return sum(e for e, _ in self.seen.values()), sum(b for _, b in self.seen.values())
