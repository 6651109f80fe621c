"""Files by byte ranges: tasks write and read parts of a file that is larger than a value.

A file is pieces (name, at, data): bytes at places that follow each other without a gap. Tasks write neighbouring pieces as one part
under a name of its own; the join copies a file's parts in order, a few megabytes at a time, under another name, and renames it.
Only parts that the finished write lists count, so tasks that are lost or run again leave nothing behind in the file.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 1 << 22  # bytes copied at a time


def store(folder: str):
    """(pyarrow file system, path in it) of a folder or file, by URI or path."""
    from pyarrow import fs

    target = "file://" + re.sub(r"^file:/*", "/", folder) if folder.startswith("file:") else folder if "://" in folder else "file://" + os.path.abspath(folder)
    return fs.FileSystem.from_uri(target)


def write_parts(pieces: DataFrame, folder: str) -> DataFrame:
    """(name, at, part, bytes) of the parts that (name, at, data) were written to; written when the result is, so write it once."""

    def run(iterator):
        disk, path = store(folder)
        disk.create_dir(f"{path}/parts", recursive=True)
        out = part = name = None
        begin = end = 0
        rows = []

        def close():
            if out is not None:
                out.close()
                rows.append((name, begin, part, end - begin))

        for batch in iterator:
            for own, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                if out is None or own != name or at != end:
                    close()
                    part, name, begin, end = uuid.uuid4().hex, own, at, at
                    out = disk.open_output_stream(f"{path}/parts/{part}")
                out.write(data)
                end += len(data)
        close()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "at", "part", "bytes"])

    dealt = pieces.select("name", "at", "data").repartitionByRange("name", "at").sortWithinPartitions("name", "at")
    return dealt.mapInArrow(run, "name string, at long, part string, bytes long")


def join_parts(parts: DataFrame, folder: str) -> DataFrame:
    """(name, bytes, digest, error) of the files that written (name, at, part, bytes) make in ``folder``: its size and SHA-256, or where a piece is missing.

    A file is copied by one task, in steps of bounded size; files are copied in parallel.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        name, place, error, digest = table["name"][0].as_py(), 0, None, hashlib.sha256()
        rows = list(zip(*(table[c].to_pylist() for c in ("at", "part", "bytes"))))
        for at, _, size in rows:
            if at != place and error is None:
                error = f"byte {place} is followed by byte {at}"
            place = at + size
        disk, path = store(folder)
        if error is None:
            made = f"{path}/.{uuid.uuid4().hex}"
            with disk.open_output_stream(made) as out:
                for _, part, size in rows:
                    with disk.open_input_stream(f"{path}/parts/{part}") as data:
                        while block := data.read(STEP):
                            out.write(block)
                            digest.update(block)
            disk.move(made, f"{path}/{name}")
        return pa.table({"name": [name], "bytes": pa.array([place if error is None else None], pa.int64()), "digest": pa.array([digest.hexdigest() if error is None else None], pa.string()), "error": pa.array([error], pa.string())})

    return parts.groupBy("name").applyInArrow(run, "name string, bytes long, digest string, error string")


def write(pieces: DataFrame, folder: str, keep) -> DataFrame:
    """(name, bytes, digest, error): files of (name, at, data) in ``folder``. ``keep`` writes a table once and reads it again."""
    return keep(join_parts(keep(write_parts(pieces, folder)), folder))


def read_at(rows: DataFrame, path: str = "path", at: str = "at", size: str = "size") -> DataFrame:
    """``rows`` with ``data``: ``size`` bytes of the file ``path`` from place ``at``; fewer where the file ends. Only those bytes are read."""
    names = [c for c in rows.columns if c != "data"]
    ordered = rows.select(path, at, size, *[c for c in names if c not in (path, at, size)])

    def run(iterator):
        held = file = None
        for batch in iterator:
            out = []
            for name, place, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if name != held:
                    if file is not None:
                        file.close()
                    disk, where = store(name)
                    held, file = name, disk.open_input_file(where)
                out.append(file.read_at(n, place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "data"])
        if file is not None:
            file.close()

    kinds = ", ".join(f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in ordered.columns)
    return ordered.mapInArrow(run, f"{kinds}, data binary").select(*names, F.col("data"))
