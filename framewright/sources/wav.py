"""WAV files as sample tables, read and written by Spark tasks, a file to a row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 16  # samples in a row
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE  # fixed values of the format
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")  # fixed value: the rest of an extensible format's name
SCHEMA = "path string, rate int, channels int, channel int, start long, v array<float>, error string"
_ARROW = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("channel", pa.int32()), ("start", pa.int64()), ("v", pa.list_(pa.float32())), ("error", pa.string())])


def parse(data: bytes, divisor: int = 32767) -> tuple[int, np.ndarray]:
    """(rate, float32 samples [channel, frame]) of PCM16, PCM24 or float32 data; ValueError for anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(part) < 16:
                raise ValueError("WAV format cut short")
            fmt = struct.unpack_from("<HHIIHH", part)
            if fmt[0] == EXTENSIBLE and len(part) >= 26:
                fmt = (struct.unpack_from("<H", part, 24)[0], *fmt[1:])
        elif name == b"data":
            body = part
        at += 8 + size + size % 2  # chunks of odd size are padded
    if fmt is None or body is None:
        raise ValueError("WAV file without format or data")
    kind, channels, rate, _, _, bits = fmt
    if not channels or (kind, bits) not in ((PCM, 16), (PCM, 24), (FLOAT, 32)):
        raise ValueError(f"WAV format {kind} with {bits} bits and {channels} channels isn't read")
    body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
    if (kind, bits) == (PCM, 16):
        flat = (np.frombuffer(body, "<i2") / np.float32(divisor)).astype(np.float32)
    elif (kind, bits) == (PCM, 24):
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        flat = (np.where(whole >= 1 << 23, whole - (1 << 24), whole) / np.float32(8388608)).astype(np.float32)
    else:
        flat = np.frombuffer(body, "<f4")
    return rate, flat.reshape(-1, channels).T


def assemble(rate: int, samples: np.ndarray, bits: int = 16) -> bytes:
    """A file of samples [channel, frame]: whole numbers as PCM16 or PCM24 (an extensible header), floats as float32 (``bits`` 32)."""
    channels, n = samples.shape
    flat = np.ascontiguousarray(samples.T)
    if bits == 24:
        body = flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = flat.astype("<i2" if bits == 16 else "<f4").tobytes()
    width = channels * bits // 8
    kind = {16: PCM, 24: EXTENSIBLE, 32: FLOAT}[bits]
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * width, width, bits)
    if bits == 24:
        fmt += struct.pack("<HHIH", 22, 24, 0, PCM) + GUID_TAIL
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body + pad


def read(spark: SparkSession, path: str, divisor: int = 32767, pattern: str = "*.wav", limit: int = 1 << 30) -> DataFrame:
    """(path, rate, channels, channel, start, v, error): blocks of samples of every file.

    A file that can't be read gives one row with its ``error`` and no samples; one of over ``limit`` bytes isn't opened. Spark doesn't list files of no bytes.
    """

    def run(iterator):
        for batch in iterator:
            for name, size, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    if size > limit:
                        raise ValueError(f"WAV file of over {limit} bytes")
                    rate, samples = parse(content.as_py(), divisor)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": name, "error": str(e)}], schema=_ARROW)
                    continue
                for c, line in enumerate(samples):
                    for k in range(0, len(line), BLOCK):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, rate, len(samples), c, k, line[k : k + BLOCK], None), _ARROW.types)], schema=_ARROW)

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.when(F.col("length") <= limit, F.col("content")).alias("content")).mapInArrow(run, SCHEMA)


def files(blocks: DataFrame, bits: int = 16) -> DataFrame:
    """(path, content): a file of each path from its blocks. PCM16 is clamped to 0.99 and cut towards zero, PCM24 clamped to 1 and rounded; 32 bits keep the floats."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("channel", "ascending"), ("start", "ascending")])
        channel = table.column("channel").to_numpy()
        lines = [np.concatenate([np.asarray(v.values, np.float64) for v, c in zip(table.column("v"), channel) if c == k]) for k in range(int(channel.max()) + 1)]
        values = np.stack(lines)
        if bits == 16:
            values = np.trunc(np.clip(values, -0.99, 0.99) * 32767).astype(np.int16)
        elif bits == 24:
            values = np.rint(np.clip(values * 8388608, -8388608, 8388607)).astype(np.int32)
        return pa.table({"path": table.column("path")[:1], "content": pa.array([assemble(table.column("rate")[0].as_py(), values, bits)], pa.binary())})

    return blocks.select("path", "rate", "channel", "start", "v").groupBy("path").applyInArrow(run, "path string, content binary")


def samples(blocks: DataFrame) -> DataFrame:
    """(path, channel, i, v) of blocks; files with an error have none."""
    return blocks.where(F.col("v").isNotNull()).select("path", "channel", "start", F.posexplode("v").alias("k", "v")).select("path", "channel", (F.col("start") + F.col("k")).alias("i"), "v")
