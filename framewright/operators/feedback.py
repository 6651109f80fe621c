"""Coding with feedback: the counts of a symbol are chosen by the symbols before it.

A context is a codebook and its symbols in the ``order`` frames before, each plus one; 0 stands for frames before the
window's first, so a window always begins in the same state. Counts are a table (model, cdf), a row a context.

An encoder knows all symbols: contexts are a projection, and each symbol meets its own two counts in a join, so a table of any
size will do. A decoder has to follow symbol by symbol: there the table is part of the model, broadcast after a check of its
size. A segment is one sequence; segments are coded in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from . import codec, probability
from .entropy import BITS, Decoder, Encoder


@dataclass(frozen=True)
class Context:
    """``order`` frames of a codebook's own symbols, each below ``cardinality``, within a window of ``window`` frames."""

    books: int
    cardinality: int
    order: int = 1
    window: int = 75

    def model(self, book: int, before: list) -> int:
        """The context's number; ``before``: the codebook's symbols plus one, the last frame's first."""
        number = 0
        for symbol in reversed(before):
            number = number * (self.cardinality + 1) + symbol
        return number * self.books + book

    def models(self, codes: Column) -> Column:
        """The same for every place of a segment's codes (frame by frame, codebook by codebook)."""

        def one(all_codes, k):
            at = F.floor(k / F.lit(self.books)) % self.window
            number = F.lit(0).cast("long")
            for back in range(self.order, 0, -1):
                symbol = F.when(at >= back, F.get(all_codes, k - back * self.books) + 1).otherwise(0)
                number = number * (self.cardinality + 1) + symbol
            return number * self.books + k % self.books

        each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda k: one(c, k))
        return F.when(F.size(codes) > 0, let(codes, each)).otherwise(F.array().cast("array<bigint>"))


def learn(codes: DataFrame, context: Context, keys: tuple = ("track", "seg")) -> DataFrame:
    """(model, cdf) from (keys, t, book, code): every context that occurs, its symbols counted with one more of each."""
    held = codes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "book", "code"))).alias("x"))
    held = held.select(F.transform("x", lambda c: c["code"].cast("long")).alias("codes"))
    seen = held.select(F.explode(F.arrays_zip(context.models(F.col("codes")).alias("model"), F.col("codes").alias("code"))).alias("s"))
    counts = seen.groupBy("s.model", "s.code").count().groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("code", "count"))).alias("n"), F.sum("count").alias("total"))
    share = lambda c: (F.coalesce(F.element_at("n", c.cast("long")), F.lit(0)) + 1) / (F.col("total") + context.cardinality)
    pdfs = counts.select(F.col("model").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(context.cardinality - 1)), share).alias("pdf"))
    return probability.allocate(pdfs).withColumnRenamed("id", "model")


def encode_segments(rows: DataFrame, tables: DataFrame, context: Context, keys: tuple = ("track", "seg"), bits: int = BITS) -> DataFrame:
    """(keys, payload, symbols, wide, error) from (keys, codes): a segment's codes frame by frame, or why it can't be coded.

    An error: a symbol whose context has no counts, or one that these don't have. A segment without codes is an empty payload.
    """
    pairs = F.arrays_zip(context.models(F.col("codes")).alias("model"), F.col("codes").alias("code"))
    symbols = rows.select(*keys, F.posexplode_outer(pairs).alias("at", "s")).select(*keys, "at", "s.model", "s.code")
    found = symbols.join(tables.select("model", "cdf"), "model", "left")
    code = F.col("code").cast("int")
    below = F.when(code > 0, F.get("cdf", code - 1)).otherwise(F.lit(0).cast("long"))
    error = F.when(F.col("at").isNull(), None).when(F.col("cdf").isNull(), "no counts for this context").when((code < 0) | (code >= F.size("cdf")), "symbol is out of range")
    share = F.struct("at", below.alias("below"), F.get("cdf", code).alias("upto"), error.alias("error"))
    held = found.groupBy(*keys).agg(F.array_sort(F.collect_list(share)).alias("x"))
    wrong = F.get(F.filter("x", lambda s: s["error"].isNotNull()), F.lit(0))
    held = held.withColumn("error", F.when(wrong.isNotNull(), F.concat(wrong["error"], F.lit(" at symbol "), wrong["at"].cast("string"))))
    shares = F.filter("x", lambda s: s["at"].isNotNull())
    held = held.select(*keys, "error", F.transform(shares, lambda s: s["below"]).alias("below"), F.transform(shares, lambda s: s["upto"]).alias("upto"))

    def run(iterator):
        for batch in iterator:
            n = len(keys)
            made, sizes, wide = [], [], []
            for error, below, upto in zip(*(batch.column(k).to_pylist() for k in range(n, n + 3))):
                coder = Encoder(bits)
                for share in zip(below, upto) if error is None else ():
                    coder.push(*share)
                made.append(coder.finish() if error is None else None)
                sizes.append(len(below))
                wide.append(coder.state.widest > 64)
            columns = [*(batch.column(k) for k in range(n)), pa.array(made, pa.binary()), pa.array(sizes, pa.int64()), pa.array(wide, pa.bool_()), batch.column(n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "payload", "symbols", "wide", "error"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return held.mapInArrow(run, f"{kinds}, payload binary, symbols long, wide boolean, error string")


class Tables:
    """Counts by context, for a decoder: one matrix, whose size is checked before it is sent to anyone."""

    def __init__(self, tables: DataFrame, context: Context, limit: int = 1 << 24):
        most = limit // context.cardinality
        rows = tables.select("model", "cdf").limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise ValueError(f"more than {most} contexts of {context.cardinality} counts")
        flat = rows["cdf"].combine_chunks().flatten().to_numpy()
        if len(flat) != rows.num_rows * context.cardinality:
            raise ValueError("counts of another cardinality")
        self.context, self.cdfs = context, flat.reshape(-1, context.cardinality).astype(np.int32)
        self.place = {m: k for k, m in enumerate(rows["model"].to_pylist())}

    def cdf(self, book: int, before: list) -> np.ndarray:
        place = self.place.get(self.context.model(book, before))
        if place is None:
            raise ValueError("no counts for this context")
        return self.cdfs[place]


class History:
    """A codebook's last symbols plus one, for all codebooks; forgotten where a window begins."""

    def __init__(self, context: Context, steps: int = 0, before: list | None = None):
        self.context, self.steps = context, steps
        self.before = before if before is not None else [[0] * context.order for _ in range(context.books)]

    def begin(self) -> None:
        if self.steps % self.context.window == 0:
            self.before = [[0] * self.context.order for _ in range(self.context.books)]

    def end(self, symbols: list) -> None:
        self.before = [[s + 1, *b[:-1]] if b else b for s, b in zip(symbols, self.before)]
        self.steps += 1


def decode_frames(data: bytes, frames: int, tables: Tables, bits: int = BITS) -> list:
    """The codes of so many frames; ValueError if the bytes run out or a context has no counts."""
    coder, past, out = Decoder(data, bits), History(tables.context), []
    for _ in range(frames):
        past.begin()
        symbols = [coder.pull(tables.cdf(b, past.before[b])) for b in range(tables.context.books)]
        past.end(symbols)
        out += symbols
    return out


def decode_segments(rows: DataFrame, tables: DataFrame, context: Context, keys: tuple = ("track", "seg"), bits: int = BITS) -> DataFrame:
    """(keys, codes, error) from (keys, frames, payload): the inverse of :func:`encode_segments`; a null payload stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(Tables(tables, context))

    def one(frames, data):
        try:
            return (None if data is None else decode_frames(data, frames, shared.value, bits)), None
        except ValueError as e:
            return None, str(e)

    def run(iterator):
        for batch in iterator:
            n = len(keys)
            found = [one(*x) for x in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.list_(pa.int64()), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *columns], names=[*keys, "codes", "error"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "frames", "payload").mapInArrow(run, f"{kinds}, codes array<long>, error string")


def encode(codes: DataFrame, tracks: DataFrame, tables: DataFrame, spec: codec.Spec, context: Context, scales: DataFrame | None = None) -> DataFrame:
    """(track, content, wide): as :func:`codec.encode`, with counts by context. The job fails at a segment that can't be coded."""
    rows = codec.segment_rows(codes, tracks, spec, scales)
    made = encode_segments(rows, tables, context, keys=("track", "seg", "scale"))
    whole = F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("segment"), F.col("track").cast("string"), F.col("seg").cast("string"), "error")).cast("binary"))
    if spec.normalise:
        whole = F.concat(F.udf(lambda s: codec.with_scale(s, b"", spec), "binary", useArrow=True)("scale"), whole)
    return codec.assembled(tracks, made.select("track", F.col("seg").alias("chunk"), whole.alias("payload"), "wide"), spec)


def decode(payloads: DataFrame, tables: DataFrame, spec: codec.Spec, context: Context) -> DataFrame:
    """(track, seg, scale, codes, error) of the chunks of (track, content): as :func:`codec.decoded`, with counts by context."""
    shared = payloads.sparkSession.sparkContext.broadcast(Tables(tables, context))
    return codec.decoded_by(payloads, spec, lambda frames, body: decode_frames(body, frames, shared.value))
