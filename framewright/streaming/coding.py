"""Incremental coding of segments whose frames arrive over time: keyed state over micro-batches.

The state of a segment is the coder's registers, its open bits, the place in the window and the last symbols; it is kept in Spark's
state store, so a job that is stopped goes on where its checkpoint is. However frames are dealt to batches, the bytes are
those of :func:`framewright.operators.feedback.encode_segments`.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entropy import Encoder
from ..operators.feedback import Context, History, Tables

STATE = "low string, high string, places long, widest long, bytes binary, bits binary, steps long, before string, waiting string, frames long, error string"
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
KINDS = pa.schema([("segment", pa.string()), *((c.split()[0], _ARROW[c.split()[1]]) for c in STATE.split(", "))])


class SegmentCoder:
    """A segment's coder: frames are pushed in order; what it holds can be saved and restored."""

    def __init__(self, tables: Tables, saved: tuple | None = None):
        self.tables = tables
        names = [c.split()[0] for c in STATE.split(", ")]
        s = dict(zip(names, saved)) if saved else None
        self.coder = Encoder.restored(s) if s else Encoder()
        self.past = History(tables.context, int(s["steps"]), json.loads(s["before"])) if s else History(tables.context)
        self.waiting = {int(t): x for t, x in json.loads(s["waiting"]).items()} if s else {}
        self.frames = int(s["frames"]) if s else -1  # of the whole segment, once the last has come
        self.error = s["error"] if s else None

    def saved(self) -> tuple:
        c = self.coder.saved()
        return (c["low"], c["high"], c["places"], c["widest"], c["bytes"], c["bits"], self.past.steps, json.dumps(self.past.before), json.dumps(self.waiting), self.frames, self.error)

    def push(self, symbols: list) -> None:
        """One frame: a symbol of each codebook. The first that can't be coded makes the segment an error."""
        self.past.begin()
        for book, symbol in enumerate(symbols if self.error is None else ()):
            at = self.past.steps * self.tables.context.books + book
            try:
                cdf = self.tables.cdf(book, self.past.before[book])
            except ValueError as e:
                self.error = f"{e} at symbol {at}"
                break
            if not 0 <= symbol < len(cdf):
                self.error = f"symbol is out of range at symbol {at}"
                break
            self.coder.push(int(cdf[symbol - 1]) if symbol else 0, int(cdf[symbol]))
        self.past.end(symbols)

    def take(self, t: int, symbols: list, last: bool) -> None:
        """Frame ``t``, in any order; those that are early wait, those that were there are left out."""
        if t >= self.past.steps:
            self.waiting[t] = symbols
        if last:
            self.frames = t + 1
        while self.past.steps in self.waiting:
            self.push(self.waiting.pop(self.past.steps))

    @property
    def complete(self) -> bool:
        return self.past.steps == self.frames

    def finish(self, padded: int = 0) -> tuple:
        """(payload, frames, wide, error), after frames of zeros up to ``padded``."""
        while self.past.steps < padded:
            self.push([0] * self.tables.context.books)
        return (self.coder.finish() if self.error is None else None, self.past.steps, self.coder.state.widest > 64, self.error)


def _kept(coders: dict) -> tuple:
    """The open segments of a call as one value: an Arrow table of their names and registers."""
    columns = zip(*((name, *saved) for name, saved in coders.items()))
    table = pa.table([pa.array(c, t) for c, t in zip(columns, KINDS.types)], schema=KINDS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, KINDS) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _open(saved: tuple) -> dict:
    table = pa.ipc.open_stream(saved[0]).read_all()
    return {name: rest for name, *rest in zip(*(c.to_pylist() for c in table.columns))}


def coded(frames: DataFrame, tables: DataFrame, context: Context, keys: tuple = ("track", "seg"), padded: int = 0, bundles: int | None = None) -> DataFrame:
    """(keys, payload, frames, wide, error), once for each segment of a stream (keys, t, symbols, last).

    A row is a frame: a symbol of each codebook. A segment is complete when its last frame and all before it have come; then it is
    filled up with zeros to ``padded`` frames and its state is given back. Frames may come in any order and in any batches; one that comes
    again before that counts once. ``tables`` (model, cdf) is a static table, its size checked. A frame with another number of symbols than
    there are codebooks fails the job.

    A call of Python and a row of state cost milliseconds, a short segment much less: ``bundles`` deals the segments by hash to so many
    groups that have those in common. It is part of the checkpoint, and should be large enough that a group has some hundred open segments. None: each segment is a group.
    """
    shared = frames.sparkSession.sparkContext.broadcast(Tables(tables, context))
    books = context.books

    def run(_, parts, state):
        held, coders = _open(state.get) if state.exists else {}, {}
        for part in parts:
            for name, t, symbols, last in zip(part["segment"], part["t"], part["symbols"], part["last"]):
                if len(symbols) != books:
                    raise ValueError(f"frame {t} of {name} has {len(symbols)} symbols, {books} are needed")
                if name not in coders:
                    coders[name] = SegmentCoder(shared.value, held.pop(name, None))
                coders[name].take(int(t), [int(s) for s in symbols], bool(last))
        done = [(name, *coder.finish(padded)) for name, coder in coders.items() if coder.complete]
        held |= {name: coder.saved() for name, coder in coders.items() if not coder.complete}
        if held:
            state.update(_kept(held))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["segment", "payload", "frames", "wide", "error"])

    formats = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    rows = frames.select(F.to_json(F.struct(*keys), formats).alias("segment"), "t", "symbols", "last")
    bundle = F.col("segment") if bundles is None else F.pmod(F.xxhash64("segment"), F.lit(bundles))
    done = rows.withColumn("bundle", bundle).groupBy("bundle").applyInPandasWithState(run, "segment string, payload binary, frames long, wide boolean, error string", "open binary", "append", "NoTimeout")
    return done.select(F.from_json("segment", kinds, formats).alias("k"), "payload", "frames", "wide", "error").select("k.*", "payload", "frames", "wide", "error")
