"""Bytes of rows as files of the shared folder: a task writes its own rows."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame


def write(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) to ``folder``, each under another name first; (name, bytes) of what was written.

    The files are written when the returned table is; a task that runs again writes the same ones.
    """

    def run(iterator):
        from pyarrow import fs

        target = "file://" + re.sub(r"^file:/*", "/", folder) if folder.startswith("file:") else folder if "://" in folder else "file://" + os.path.abspath(folder)
        store, path = fs.FileSystem.from_uri(target)
        store.create_dir(path, recursive=True)
        for batch in iterator:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1)):
                part = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py() or b"")
                store.move(part, f"{path}/{name}")
                sizes.append(len(content.as_py() or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long")
