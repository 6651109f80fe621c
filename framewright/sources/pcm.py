"""Raw little-endian float samples, interleaved and without a header: scan and bytes of a sink."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 16  # samples in a row


def read(spark: SparkSession, path: str, channels: int = 1, frames: int | None = None, pattern: str = "*.f32", strict: bool = True) -> DataFrame:
    """(path, start, v, error): blocks of interleaved samples of every file; ``frames`` of them are wanted, all if not given.

    A file that is shorter, or that ends within a frame, is an error; unless ``strict`` it is a row with that error.
    """

    names, types = ["path", "start", "v", "error"], [pa.string(), pa.int64(), pa.list_(pa.float32()), pa.string()]

    def run(iterator):
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                need = len(data) if frames is None else 4 * channels * frames
                if len(data) < need or need % (4 * channels):
                    error = f"{name} has {len(data)} bytes, {need} are needed in frames of {4 * channels}"
                    if strict:
                        raise ValueError(error)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, None, None, error), types)], names=names)
                    continue
                v = np.frombuffer(data, "<f4", need // 4)
                starts = range(0, len(v), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(list(starts), pa.int64()), pa.array([v[k : k + BLOCK] for k in starts], pa.list_(pa.float32())), pa.nulls(len(starts), pa.string())], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(run, "path string, start long, v array<float>, error string")


def contents(tracks: DataFrame) -> DataFrame:
    """(name, content) from (name, v): an array of interleaved samples as its bytes."""

    def run(iterator):
        for batch in iterator:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(v.values).astype("<f4").tobytes() for v in batch.column(1)], pa.binary())], names=["name", "content"])

    return tracks.selectExpr("name", "cast(v AS array<float>) AS v").mapInArrow(run, "name string, content binary")
