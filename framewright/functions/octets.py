"""Bytes as column expressions: integers, chunk frames, container headers, bit packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Fixed values of the container format.
MAGIC, VERSION, HEADER_BYTES, FRAME_BYTES = "ECDC", 0, 9, 8


def u32(x: Column) -> Column:
    """A whole number as four bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0"))


def read_u32(data: Column, at) -> Column:
    """The big-endian number in the four bytes from place ``at`` (from 1)."""
    at = at.cast("int") if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("long")


def chunk_frame(payload: Column, with_crc: bool = True) -> Column:
    """length · crc32 · payload (no crc: length · payload)."""
    parts = [u32(F.octet_length(payload))] + [u32(F.crc32(payload))] * with_crc + [payload]
    return F.concat(*parts)


def chunk_payload(frame: Column) -> Column:
    """struct(payload, error) of one frame that fills its bytes: cut short, damaged or followed by more is an error."""
    size, body = read_u32(frame, 1), F.substring(frame, F.lit(9), F.lit(2**31 - 1))
    error = (
        F.when(F.octet_length(frame) < FRAME_BYTES, "frame cut short")
        .when(F.octet_length(body) < size, "payload cut short")
        .when(F.octet_length(body) > size, "bytes follow")
        .when(F.crc32(body) != read_u32(frame, 5), "checksum differs")
    )
    return F.struct(F.when(error.isNull(), body).alias("payload"), error.alias("error"))


def header(metadata_json: Column) -> Column:
    """magic · version · length · JSON."""
    raw = metadata_json.cast("binary")
    return F.concat(F.lit(MAGIC).cast("binary"), F.unhex(F.lit(f"{VERSION:02x}")), u32(F.octet_length(raw)), raw)


def read_header(data: Column) -> Column:
    """struct(json, size, error) of a container's beginning; ``size`` is where the chunks begin."""
    n = read_u32(data, 6)
    error = (
        F.when(F.octet_length(data) < HEADER_BYTES, "header cut short")
        .when(F.substring(data, 1, 4) != F.lit(MAGIC).cast("binary"), "not a container")
        .when(F.substring(data, 5, 1) != F.unhex(F.lit(f"{VERSION:02x}")), "unknown version")
        .when(F.octet_length(data) < n + HEADER_BYTES, "header cut short")
    )
    json = F.decode(F.substring(data, F.lit(HEADER_BYTES + 1), F.when(error.isNull(), n).otherwise(0).cast("int")), "UTF-8")
    return F.struct(F.when(error.isNull(), json).alias("json"), F.when(error.isNull(), n + HEADER_BYTES).alias("size"), error.alias("error"))


def pack_bits(values: Column, bits: int) -> Column:
    """An array of whole numbers below 2^bits as bytes, least significant bit first, the last byte padded with zeros.

    Eight numbers at a time fill ``bits`` whole bytes, so the work grows with the array's length.
    """

    def group(g):
        text = F.array_join(F.transform(F.slice(values, g * 8 + 1, 8), lambda v: F.reverse(F.lpad(F.conv(v.cast("string"), 10, 2), bits, "0"))), "")
        byte = lambda t, k: F.lpad(F.conv(F.reverse(F.rpad(F.substring(t, k * 8 + 1, F.lit(8)), 8, "0")), 2, 16), 2, "0")
        return let(text, lambda t: F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / F.lit(8)).cast("int") - 1), lambda k: byte(t, k)), ""))

    groups = F.sequence(F.lit(0), F.ceil(F.size(values) / F.lit(8)).cast("int") - 1)
    return F.when(F.size(values) == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(F.transform(groups, group), "")))


def unpack_bits(data: Column, bits: int, count: Column) -> Column:
    """The first ``count`` numbers packed by :func:`pack_bits`; null for those that the bytes don't hold."""

    def group(g):
        part = F.substring(data, g * bits + 1, F.lit(bits))
        one = lambda h, k: F.reverse(F.lpad(F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 2), 8, "0"))
        text = let(F.hex(part), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(part) - 1)), lambda k: one(h, k)), ""))
        value = lambda t, k: F.when(F.length(t) >= (k + 1) * bits, F.conv(F.reverse(F.substring(t, k * bits + 1, F.lit(bits))), 2, 10).cast("int"))
        return let(text, lambda t: F.transform(F.sequence(F.lit(0), F.least(F.lit(7), count.cast("int") - 1 - g * 8)), lambda k: value(t, k)))

    groups = F.sequence(F.lit(0), F.ceil(count / F.lit(8)).cast("int") - 1)
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(groups, group)))


def first_chunk(data: Column) -> Column:
    """Place and framed size of a container's first chunk from its header alone: struct(place, bytes); no checksum is read."""
    at = read_u32(data, 6) + HEADER_BYTES
    whole = read_header(data)["error"].isNull() & (F.octet_length(data) >= at + 4)
    return F.struct(F.when(whole, at).alias("place"), F.when(whole, read_u32(data, at + 1) + FRAME_BYTES).alias("bytes"))
