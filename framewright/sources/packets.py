"""Packet caches: an envelope of JSON, then the packets' bytes one after the other.

Layout (big-endian): magic, 4 bytes; length of the JSON, u32; JSON; buffers. The JSON names a format, holds a payload whose
packets are placeholders of buffer numbers, and lists the buffers' lengths.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.octets import u32


@dataclass(frozen=True)
class Format:
    """The names that a cache's writer and reader agree on."""

    magic: bytes = b"PKT1"
    name: str = "packet-cache.v1"
    packets: str = "packets"  # key of the payload's placeholders
    buffer: str = "buffer"  # key of a placeholder's number


def contents(packets: DataFrame, key: str, fmt: Format = Format(), fields: dict | None = None, limit: int = 1 << 30) -> DataFrame:
    """(key, content) from (key, packet, data): one cache of a key's packets in order; ``fields``: more of the payload, as aggregates by name.

    A cache is one value: one of over ``limit`` bytes of packets is an error.
    """
    numbers = F.sequence(F.lit(0).cast("long"), F.count(F.lit(1)) - 1)
    marks = F.transform(numbers, lambda k: F.struct(k.alias(fmt.buffer)))
    payload = F.struct(*[c.alias(n) for n, c in (fields or {}).items()], marks.alias(fmt.packets))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("packet", F.octet_length("data").alias("n")))), lambda x: F.struct(x["n"].alias("byteLength")))
    envelope = F.to_json(F.struct(F.lit(fmt.name).alias("format"), payload.alias("payload"), sizes.alias("buffers")))
    body = F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY packet)")
    small = F.when(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)) > limit, F.raise_error(F.lit(f"a packet cache has at most {limit} bytes"))).otherwise(F.lit(0))
    held = packets.groupBy(key).agg(envelope.cast("binary").alias("json"), body.alias("body"), small.alias("small"))
    return held.where("small IS NULL OR small = 0").select(key, F.concat(F.lit(fmt.magic), u32(F.octet_length("json")), F.col("json"), F.coalesce("body", F.lit(b""))).alias("content"))


def parse(data: bytes, fmt: Format = Format()) -> tuple[dict, list]:
    """(payload, packets in order) of a cache; ValueError says what is wrong with it."""
    if len(data) < 8 or data[:4] != fmt.magic:
        raise ValueError("not a packet cache")
    at = 8 + int.from_bytes(data[4:8], "big")
    if at > len(data):
        raise ValueError("envelope cut short")
    envelope = json.loads(data[8:at])
    if envelope.get("format") != fmt.name:
        raise ValueError("envelope format differs")
    if envelope.get("payload") is None:
        raise ValueError("payload is missing")
    if envelope.get("buffers") is None:
        raise ValueError("buffers are missing")
    buffers = []
    for k, entry in enumerate(envelope["buffers"]):
        size = entry.get("byteLength")
        if size is None:
            raise ValueError(f"buffer {k} has no length")
        if type(size) is not int or size < 0:
            raise ValueError(f"buffer {k} has a length that isn't a whole number from 0")
        if at + size > len(data):
            raise ValueError(f"buffer {k} is cut short")
        buffers.append(data[at : at + size])
        at += size
    if at < len(data):
        raise ValueError("bytes follow the buffers")
    marks = envelope["payload"].get(fmt.packets) or []
    if not marks:
        raise ValueError("no packets")
    for k, mark in enumerate(marks):
        if type(mark[fmt.buffer]) is not int or not 0 <= mark[fmt.buffer] < len(buffers):
            raise ValueError(f"packet {k} names a missing buffer")
    return envelope["payload"], [buffers[mark[fmt.buffer]] for mark in marks]


def packets_of(caches: DataFrame, key: str, fmt: Format = Format()) -> DataFrame:
    """(key, packet, data, payload, error) from (key, content): a row per packet, or one with the cache's error; ``payload`` is JSON."""

    def run(iterator):
        for batch in iterator:
            for name, content in zip(batch.column(0), batch.column(1)):
                try:
                    payload, found = parse(content.as_py() or b"", fmt)
                    rows = [(k, data, json.dumps(payload), None) for k, data in enumerate(found)]
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows = [(None, None, None, str(e))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), batch.column(0).type), *columns], names=[key, "packet", "data", "payload", "error"])

    return caches.select(key, "content").mapInArrow(run, f"{key} {caches.schema[key].dataType.simpleString()}, packet long, data binary, payload string, error string")


def changing(packets: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys whose packets don't all have the same ``columns`` (rate, channels): a cache of those can't be played as one."""
    same = F.lit(True)
    for c in columns:
        same = same & F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1)))
    return packets.groupBy(key).agg(same.alias("same")).where("NOT same").select(key)
