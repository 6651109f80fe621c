"""Code sequences to containers and back as one function each: segments, windows, coder, chunks, header.

A frame model is anything that gives codes (track, seg, t, book, code); the distributions that its entropy model would
produce are a table of cumulative counts (model, cdf), and :class:`Spec` says which of them codes the symbol at a
place. Nothing is collected: a segment is a row, and its frames and codebooks bound it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout
from . import containers
from .entropy import decode_symbols, encode_symbols, shared_tables


@dataclass(frozen=True)
class Spec:
    """What encoder and decoder agree on. A window of ``window`` frames begins with the model's initial state."""

    model: str
    books: int
    samples: int  # of a segment
    stride: int
    frames: int  # of a segment
    model_hash: str = ""
    window: int = 75
    channels: int = 1
    normalise: bool = False  # a segment's scale stands before its codes
    model_of: Callable[[int, int], int] = lambda at, book: at  # (frame's place in its window, codebook) -> model
    tau: float = 1.0  # what the counts were made with: temperature, scale of probabilities, smallest share
    fp: int = 8192
    mr: int = 2

    @property
    def settings(self) -> dict:
        return {"tau": self.tau, "fp": self.fp, "mr": self.mr}

    def models(self, frames: int) -> list:
        """The model of each symbol: frame by frame, codebook by codebook."""
        return [self.model_of(t % self.window, b) for t in range(frames) for b in range(self.books)]


def segments(tracks: DataFrame, spec: Spec, samples: Column, stride: Column, stored_frames: Column | None = None) -> DataFrame:
    """(track, seg, start, n, frames) from (track, total) and a layout of each track."""
    out = tracks.select("track", "total", samples.alias("__samples"), stored_frames.alias("__frames") if stored_frames is not None else F.lit(None).cast("long").alias("__frames"), F.posexplode(layout.segment_starts(F.col("total"), stride)).alias("seg", "start"))
    n = F.least(F.col("__samples").cast("long"), F.col("total") - F.col("start"))
    frames = layout.model_frame_length(F.col("__frames"), n, F.lit(spec.samples), spec.frames)
    return out.select("track", F.col("seg").cast("long").alias("seg"), "start", n.alias("n"), frames.alias("frames"))


def shape_error(frames: Column, encoded: Column, codes: Column, books: int) -> Column:
    """Why a segment's codes can't be coded: its frame length is outside 1 .. the encoded one, or codes are missing."""
    return F.when((frames < 1) | (frames > encoded) | encoded.isNull(), "frame length out of range").when(codes != frames * books, "codes don't fill the frames")


def encode(codes: DataFrame, tracks: DataFrame, tables: DataFrame, spec: Spec, scales: DataFrame | None = None) -> DataFrame:
    """(track, content, wide): a container of each track from (track, seg, t, book, code), (track, total) and, if segments are normalised, (track, seg, scale).

    Frames beyond a segment's own length (of a padded last one) are left out. A segment without codes for all its
    frames and codebooks, without its scale, or with a code that its table doesn't have, is an error. An empty track is a header
    alone. ``wide``: a payload's register outgrew 64 bits.
    """
    shared = shared_tables(tables, 16_384)
    rows = segment_rows(codes, tracks, spec, scales)

    def run(iterator):
        for batch in iterator:
            out, wide = [], []
            for frames, symbols, scale in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                data, register = encode_symbols(symbols, [shared.value[m] for m in spec.models(frames)])
                out.append(with_scale(scale, data, spec))
                wide.append(register > 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(wide, pa.bool_())], names=["track", "chunk", "payload", "wide"])

    kind = tracks.schema["track"].dataType.simpleString()
    chunks = rows.mapInArrow(run, f"track {kind}, chunk long, payload binary, wide boolean")
    return assembled(tracks, chunks, spec)


def with_scale(scale: float | None, data: bytes, spec: Spec) -> bytes:
    """A chunk's payload: the segment's scale, if it has one, then the coded bytes."""
    return (struct.pack(">f", scale) if spec.normalise else b"") + data


def segment_rows(codes: DataFrame, tracks: DataFrame, spec: Spec, scales: DataFrame | None) -> DataFrame:
    """(track, seg, frames, codes, scale): every segment's own codes, frame by frame; the job fails at a segment that lacks some, or its scale."""
    segs = segments(tracks, spec, F.lit(spec.samples), F.lit(spec.stride))
    held = codes.groupBy("track", "seg").agg((F.max("t") + 1).alias("encoded"), F.array_sort(F.collect_list(F.struct("t", "book", "code"))).alias("x"))
    rows = segs.join(held, ["track", "seg"], "left")
    own = F.transform(F.filter("x", lambda c: c["t"] < F.col("frames")), lambda c: c["code"].cast("long"))
    rows = rows.select("track", "seg", "frames", "encoded", own.alias("codes"))
    error = shape_error(F.col("frames"), F.col("encoded"), F.size("codes").cast("long"), spec.books)
    if spec.normalise:
        rows = rows.join(scales.select("track", "seg", F.col("scale").cast("float").alias("scale")), ["track", "seg"], "left")
        error = F.coalesce(error, F.when(F.col("scale").isNull(), "scale is missing"))
    else:
        rows = rows.withColumn("scale", F.lit(None).cast("float"))
    rows = rows.withColumn("codes", F.when(error.isNull(), F.col("codes")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("segment"), F.col("track").cast("string"), F.col("seg").cast("string"), error)).cast("array<bigint>")))
    return rows.select("track", "seg", "frames", "codes", "scale")


def assembled(tracks: DataFrame, chunks: DataFrame, spec: Spec) -> DataFrame:
    """(track, content, wide): containers of (track, total) and coded segments (track, chunk, payload, wide)."""
    meta = {"m": F.lit(spec.model), "al": F.col("total"), "nc": F.lit(spec.books), "lm": F.lit(True), "fp": F.lit(spec.fp), "mr": F.lit(spec.mr), "acv": F.lit(containers.BITSTREAM), "tau": F.lit(spec.tau), "lmh": F.lit(spec.model_hash), "cs": F.lit(spec.samples), "cst": F.lit(spec.stride)}
    return containers.build(tracks.select("track", "total").join(chunks, "track", "left"), "track", "chunk", containers.metadata_json(meta), marks=["wide"])


def scan(payloads: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(tracks, chunks) of (track, content).

    tracks: (track, total, header_bytes, file_bytes, chunks, samples, stride, stored_frames, error); chunks:
    (track, chunk, place, payload, error). A track's error: its header, its metadata, or a number of chunks that no layout gives.
    """
    chunks = containers.chunks_of(payloads, "track")
    counts = chunks.where("payload IS NOT NULL OR error NOT IN ('not a container', 'header cut short')").groupBy("track").agg(F.count(F.lit(1)).alias("chunks"))
    from ..functions import octets

    heads = payloads.select("track", F.octet_length("content").cast("long").alias("file_bytes"), octets.read_header(F.col("content")).alias("h"))
    heads = heads.select("track", "file_bytes", F.col("h.size").cast("long").alias("header_bytes"), F.col("h.error").alias("broken"), containers.parse_metadata(F.col("h.json")).alias("m"))
    heads = heads.join(counts, "track", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
    stored = F.col("m.cs").isNotNull() | F.col("m.cst").isNotNull()
    own = layout.resolve_layout(F.col("m.cs"), F.col("m.cst"), spec.samples, spec.stride)
    found = layout.layout_for_count(F.col("m.al"), F.col("chunks"), spec.samples, spec.stride)
    own_fits = own["valid"] & (layout.segment_count(F.col("m.al"), own["stride"]) == F.col("chunks"))
    pick = lambda name: F.when(stored, F.when(own_fits, own[name])).otherwise(found[name])
    broken = F.coalesce("broken", containers.violation(F.col("m"), spec.model, spec.books, spec.model_hash, F.col("chunks"), spec.settings))
    tracks = heads.select("track", F.col("m.al").alias("total"), "header_bytes", "file_bytes", "chunks", pick("samples").alias("samples"), pick("stride").alias("stride"), F.col("m.fl").alias("stored_frames"), broken.alias("error"))
    return tracks.withColumn("error", F.coalesce("error", F.when(F.col("stride").isNull() & (F.col("chunks") > 0), "chunk count differs"))), chunks


def inspect(payloads: DataFrame, spec: Spec, rate: int = layout.SAMPLE_RATE) -> DataFrame:
    """(track, chunk, offset, samples, duration_ms, frames, chunk_bytes, payload_bytes, cumulative_bytes, error) of every chunk."""
    from pyspark.sql import Window as W

    from ..functions.octets import FRAME_BYTES

    tracks, chunks = scan(payloads, spec)
    segs = segments(tracks.where("stride IS NOT NULL"), spec, F.col("samples"), F.col("stride"), F.col("stored_frames")).withColumnRenamed("seg", "chunk")
    size = F.octet_length("payload").cast("long")
    so_far = W.partitionBy("track").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    out = chunks.join(segs, ["track", "chunk"], "left").select("track", "chunk", F.col("start").alias("offset"), F.col("n").alias("samples"), (F.col("n") * 1000 / F.lit(float(rate))).alias("duration_ms"), "frames", (size + FRAME_BYTES).alias("chunk_bytes"), size.alias("payload_bytes"), "error")
    return out.withColumn("cumulative_bytes", F.sum("chunk_bytes").over(so_far))


def decode(payloads: DataFrame, tables: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(codes, scales) of (track, content): (track, seg, t, book, code) and (track, seg, scale), the inverse of :func:`encode`.

    Containers that :func:`scan` finds fault with, damaged chunks, and payloads that run out give nothing: their errors are there to be read
    (:func:`decoded` has the latter).
    """
    return opened(decoded(payloads, tables, spec), spec)


def opened(made: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(codes, scales) of decoded segments (track, seg, scale, codes, error): those without an error."""
    made = made.where("error IS NULL")
    codes = made.select("track", "seg", F.posexplode("codes").alias("k", "code"))
    books = F.lit(spec.books)
    codes = codes.select("track", "seg", layout.whole_div(F.col("k"), books).alias("t"), (F.col("k") % books).cast("long").alias("book"), "code")
    return codes, made.select("track", "seg", "scale")


def decoded(payloads: DataFrame, tables: DataFrame, spec: Spec) -> DataFrame:
    """(track, seg, scale, codes, error) of every whole chunk of the sound containers among (track, content): codes, or why there are none."""
    shared = shared_tables(tables, 16_384)

    def symbols(frames, body):
        return decode_symbols(body, [shared.value[m] for m in spec.models(frames)])

    return decoded_by(payloads, spec, symbols)


def decoded_by(payloads: DataFrame, spec: Spec, symbols: Callable[[int, bytes], list]) -> DataFrame:
    """(track, seg, scale, codes, error), where ``symbols`` gives the codes of so many frames from a segment's bytes, or raises ValueError."""
    tracks, chunks = scan(payloads, spec)
    segs = segments(tracks.where("error IS NULL"), spec, F.col("samples"), F.col("stride"), F.col("stored_frames"))
    rows = segs.join(chunks.where("error IS NULL").select("track", F.col("chunk").alias("seg"), "payload"), ["track", "seg"])

    def run(iterator):
        for batch in iterator:
            found = [read(frames, data) for frames, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            scales, codes, errors = (pa.array(c, t) for c, t in zip(zip(*found), DECODED)) if found else (pa.array([], t) for t in DECODED)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scales, codes, errors], names=["track", "seg", "scale", "codes", "error"])

    def read(frames, data):
        scale, body = split_scale(data, spec)
        if scale is None and spec.normalise:
            return None, None, "scale cut short"
        try:
            return scale, symbols(frames, body), None
        except ValueError as e:
            return scale, None, str(e)

    kind = payloads.schema["track"].dataType.simpleString()
    return rows.select("track", "seg", "frames", "payload").mapInArrow(run, f"track {kind}, seg long, scale float, codes array<long>, error string")


#: Types of a decoded segment's scale, codes and error.
DECODED = (pa.float32(), pa.list_(pa.int64()), pa.string())


def split_scale(data: bytes, spec: Spec) -> tuple[float | None, bytes]:
    """(scale, coded bytes) of a chunk's payload; no scale if segments aren't normalised, or if it is cut short."""
    if not spec.normalise:
        return None, data
    return (struct.unpack(">f", data[:4])[0], data[4:]) if len(data) >= 4 else (None, b"")


def residual_samples(total: Column, decoded: Column, samples: int, stride: int, segment_samples: int, frames: int, channels: int) -> Column:
    """struct(each, error): how many decoded samples a chunk of a flat buffer holds, from the buffer's length alone.

    ``each`` is -1 where chunks hold their whole frames (frame length times samples a code), -2 where they hold their own samples,
    else the same number for all: a whole segment, or an even share. An error: the buffer doesn't divide, or is too short for a chunk.
    """
    starts = layout.segment_starts(total, F.lit(stride))
    n = F.size(starts).cast("long")
    own = F.transform(starts, lambda s: F.least(F.lit(samples).cast("long"), total - s))
    per_code = max(1, segment_samples // max(frames, 1)) if segment_samples >= max(frames, 1) else 320
    native = F.transform(own, lambda x: layout.frame_length(x, F.lit(segment_samples), frames) * per_code)
    sum_ = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x) * channels
    short = lambda has: F.exists(F.zip_with(has, own, lambda a, b: a < b), lambda x: x)
    even = layout.whole_div(decoded, F.greatest(n * channels, F.lit(1).cast("long")))
    repeated = lambda x: F.transform(own, lambda _: x)
    each = F.when(decoded == sum_(native), F.lit(-1).cast("long")).when(decoded == n * channels * segment_samples, F.lit(segment_samples).cast("long")).when(decoded == sum_(own), F.lit(-2).cast("long")).otherwise(even)
    uneven = (each >= 0) & (decoded % F.greatest(n * channels, F.lit(1).cast("long")) != 0)
    has = F.when(each == -1, native).when(each == -2, own).otherwise(repeated(each))
    error = F.when(n == 0, F.lit(None).cast("string")).when(uneven, "buffer doesn't divide").when(short(has), "chunk too short")
    return F.struct(F.when(n > 0, each).alias("each"), error.alias("error"))
