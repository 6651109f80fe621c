"""Containers of chunks as tables: build, scan, validate."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.octets import HEADER_BYTES, MAGIC, VERSION, chunk_frame, header

#: Keys of the metadata object in their order, and what new files hold.
KEYS = ("m", "al", "nc", "lm", "fp", "mr", "acv", "tau", "lmh", "cs", "cst", "fl")
DEFAULTS = {"fp": 8192, "mr": 2, "acv": 0, "tau": 1.0}
BITSTREAM = 2
SETTINGS = {"tau": "temperature", "fp": "probability scale", "mr": "smallest share"}
METADATA = "m string, al long, nc int, lm boolean, fp long, mr long, acv int, tau double, lmh string, cs long, cst long, fl long"


def metadata_json(fields: dict) -> Column:
    """The metadata object in key order; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in KEYS if k in fields]))


def parse_metadata(json: Column) -> Column:
    """Known fields with their defaults, and every unknown key as text in ``extra``."""
    known = F.from_json(json, METADATA)
    filled = [F.coalesce(known[k], F.lit(DEFAULTS[k])).alias(k) if k in DEFAULTS and k != "tau" else known[k].alias(k) for k in KEYS]
    extra = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: ~k.isin(*KEYS))
    return F.struct(*filled, extra.alias("extra"))


def violation(meta: Column, model: str, codebooks: int, model_hash: str | None = None, chunks: Column | None = None, settings: dict | None = None) -> Column:
    """Why a payload doesn't suit a model; null if it does. The entropy model's hash, and the ``settings`` (tau, fp, mr) that
    counts were made with, matter to payloads that have chunks.
    """
    out = (
        F.when(meta["m"].isNull() | (meta["m"] != model), "model differs")
        .when(meta["nc"].isNull() | (meta["nc"] != codebooks), "codebooks differ")
        .when(meta["acv"] != BITSTREAM, "bitstream version differs")
        .when(~F.coalesce(meta["lm"], F.lit(False)), "no model coding")
        .when(meta["fl"] <= 0, "frame length isn't positive")
    )
    any_chunk = F.lit(True) if chunks is None else chunks > 0
    for name, value in (settings or {}).items():
        out = out.when(any_chunk & (F.coalesce(meta[name], F.lit(DEFAULTS[name])) != value), f"{SETTINGS[name]} differs")
    if model_hash is None:
        return out
    return out.when(any_chunk & meta["lmh"].isNull(), "model hash is missing").when(any_chunk & (meta["lmh"] != model_hash), "model hash differs")


def build(chunks: DataFrame, key: str, order: str, metadata: Column, limit: int = 1 << 30, marks: list = ()) -> DataFrame:
    """(key, content): header and framed chunks of each key in order. A container is one file, so one row, of ``limit`` bytes at most.

    A key whose only payload is null has no chunks: its container is the header alone. ``marks``: conditions that are kept if any chunk has them.
    """
    framed = F.when(F.col("payload").isNotNull(), chunk_frame(F.col("payload")))
    return joined(chunks.withColumn("frame", framed), key, order, metadata, limit, marks)


def joined(chunks: DataFrame, key: str, order: str, metadata: Column, limit: int = 1 << 30, marks: list = ()) -> DataFrame:
    """(key, content) of chunks that are framed already (key, order, frame); else as :func:`build`."""
    held = chunks.select(key, order, *marks, "frame", metadata.alias("json"))
    small = F.when(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)) > limit, F.raise_error(F.lit(f"a container has at most {limit} bytes"))).otherwise(F.lit(0))
    body = F.expr(f"listagg(frame, X'') WITHIN GROUP (ORDER BY `{order}`)")
    held = held.groupBy(key).agg(F.first("json", ignorenulls=True).alias("json"), body.alias("body"), small.alias("small"), *(F.coalesce(F.bool_or(m), F.lit(False)).alias(m) for m in marks))
    return held.where("small IS NULL OR small = 0").select(key, F.concat(header(F.col("json")), F.coalesce("body", F.lit(b""))).alias("content"), *marks)


def scan_container(data: bytes, with_crc: bool = True):
    """(chunk, place, payload, error) of each chunk after the header; an error ends the scan."""
    if len(data) < HEADER_BYTES or data[:4] != MAGIC.encode() or data[4] != VERSION:
        yield 0, 0, None, "not a container"
        return
    at, k, head = HEADER_BYTES + int.from_bytes(data[5:9], "big"), 0, 8 if with_crc else 4
    if at > len(data):
        yield 0, at, None, "header cut short"
        return
    while at < len(data):
        if at + head > len(data):
            yield k, at, None, "frame cut short"
            return
        size = int.from_bytes(data[at : at + 4], "big")
        body = data[at + head : at + head + size]
        error = "payload cut short" if len(body) < size else "checksum differs" if with_crc and struct.unpack(">I", data[at + 4 : at + 8])[0] != zlib.crc32(body) else None
        yield k, at, None if error else body, error
        if len(body) < size:
            return
        at, k = at + head + size, k + 1


def chunks_of(containers: DataFrame, key: str, with_crc: bool = True) -> DataFrame:
    """(key, chunk, place, payload, error) from (key, content): a row per chunk; offsets vary, so bytes are walked."""

    def run(iterator):
        for batch in iterator:
            for name, content in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = list(scan_container(content or b"", with_crc))
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.string())))], names=[key, "chunk", "place", "payload", "error"])

    return containers.select(key, "content").mapInArrow(run, f"{key} {containers.schema[key].dataType.simpleString()}, chunk long, place long, payload binary, error string")
