"""Arithmetic coding of symbol sequences: one sequence is one group, sequences are coded in parallel.

The registers are Python integers: an interval that straddles its middle for several symbols outgrows 64 bits,
and such payloads are marked (``wide``) because a 64-bit decoder couldn't read them.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 24


class Interval:
    """The coder's state: an interval of whole numbers, at least 2^bits wide before each symbol."""

    def __init__(self, bits: int = BITS):
        self.bits, self.low, self.high, self.places, self.widest = bits, 0, 0, 0, 0

    def widen(self) -> int:
        """Doubles the interval until it is wide enough; the number of places added."""
        n = 0
        while self.high - self.low + 1 < 1 << self.bits:
            self.low, self.high, n = 2 * self.low, 2 * self.high + 1, n + 1
        self.places += n
        self.widest = max(self.widest, self.places)
        return n

    def narrow(self, below: int, upto: int) -> list:
        """To the symbol's share of it; the leading places that are settled come out."""
        width = self.high - self.low + 1
        self.low, self.high = self.low + (width * below >> self.bits), self.low + (width * upto >> self.bits) - 1
        out = []
        while self.places and self.low >> (self.places - 1) == self.high >> (self.places - 1):
            self.places -= 1
            bit = self.low >> self.places
            self.low -= bit << self.places
            self.high -= bit << self.places
            out.append(bit)
        return out


class Encoder:
    """Shares of the interval in, bits out; ``held`` are the bits so far, a byte each."""

    def __init__(self, bits: int = BITS):
        self.state, self.held = Interval(bits), bytearray()

    def push(self, below: int, upto: int) -> None:
        """A symbol whose cumulative counts are ``below`` before and ``upto`` with it."""
        self.state.widen()
        self.held += bytes(self.state.narrow(below, upto))

    def finish(self) -> bytes:
        """All bytes, the register's open places with them; bits fill bytes from the lowest."""
        s = self.state
        return packed(self.held + bytes([s.low >> k & 1 for k in range(s.places - 1, -1, -1)]))

    def saved(self) -> dict:
        """The registers as text (they may pass 64 bits), whole bytes and the bits after them."""
        s, whole = self.state, len(self.held) // 8 * 8
        return {"low": str(s.low), "high": str(s.high), "places": s.places, "widest": s.widest, "bytes": packed(self.held[:whole]), "bits": bytes(self.held[whole:])}

    @classmethod
    def restored(cls, saved: dict, bits: int = BITS) -> Encoder:
        made = cls(bits)
        s = made.state
        s.low, s.high, s.places, s.widest = int(saved["low"]), int(saved["high"]), int(saved["places"]), int(saved["widest"])
        made.held = bytearray(np.unpackbits(np.frombuffer(saved["bytes"], np.uint8), bitorder="little").tobytes() + saved["bits"])
        return made


def packed(bits) -> bytes:
    """Bits, a byte each, as bytes filled from the lowest bit."""
    return np.packbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little").tobytes()


def encode_symbols(symbols, cdfs, bits: int = BITS) -> tuple[bytes, int]:
    """(bytes, widest register) of symbols, each with its own cumulative counts."""
    coder = Encoder(bits)
    for symbol, cdf in zip(symbols, cdfs):
        if not 0 <= symbol < len(cdf):
            raise ValueError(f"symbol {symbol} is out of range")
        coder.push(cdf[symbol - 1] if symbol else 0, cdf[symbol])
    return coder.finish(), coder.state.widest


class Decoder:
    """The inverse of :class:`Encoder`: a symbol at a time, so the next one's counts may depend on it."""

    def __init__(self, data: bytes, bits: int = BITS):
        self.state, self.data, self.value, self.at = Interval(bits), data, 0, 0

    def pull(self, cdf) -> int:
        """The next symbol, by its cumulative counts; ValueError if the bytes run out."""
        state = self.state
        for _ in range(state.widen()):
            if self.at >= 8 * len(self.data):
                raise ValueError("arithmetic stream exhausted")
            self.value, self.at = 2 * self.value + (self.data[self.at >> 3] >> (self.at & 7) & 1), self.at + 1
        target = (((self.value - state.low + 1) << state.bits) - 1) // (state.high - state.low + 1)
        symbol = bisect_right(cdf, target)
        if symbol >= len(cdf):
            raise ValueError("no symbol at this place")
        state.narrow(int(cdf[symbol - 1]) if symbol else 0, int(cdf[symbol]))
        self.value &= (1 << state.places) - 1
        return symbol


def decode_symbols(data: bytes, cdfs, bits: int = BITS) -> list:
    """The inverse of :func:`encode_symbols`; ValueError if the bytes run out."""
    coder = Decoder(data, bits)
    return [coder.pull(cdf) for cdf in cdfs]


def shared_tables(tables: DataFrame | None, limit: int):
    """The cumulative counts of each model as a broadcast dictionary; their number is part of a model and checked."""
    if tables is None:
        return None
    rows = tables.select("model", "cdf").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} tables of counts")
    return tables.sparkSession.sparkContext.broadcast({r.model: r.cdf for r in rows})


def _counts(table: pa.Table, shared) -> list:
    if shared is None:
        return table.column("cdf").to_pylist()
    return [shared.value[m] for m in table.column("model").to_pylist()]


def _types(df: DataFrame, names: tuple) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def encode(sequences: DataFrame, tables: DataFrame | None = None, *, keys: tuple = ("track",), bits: int = BITS, limit: int = 16_384) -> DataFrame:
    """(keys, payload, symbols, wide) from (keys, t, symbol, cdf): the symbols of a key are coded in the order of t.

    With ``tables`` (model, cdf), at most ``limit`` of them, the symbols name a ``model`` instead, and counts travel once.
    A long track should have its chunk among the keys, so that no task holds all of it.
    """
    shared = shared_tables(tables, limit)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        data, widest = encode_symbols(table.column("symbol").to_pylist(), _counts(table, shared), bits)
        return pa.table({**{k: table.column(k)[:1] for k in keys}, "payload": pa.array([data], pa.binary()), "symbols": pa.array([table.num_rows], pa.int64()), "wide": [widest > 64]})

    rows = sequences.select(*keys, "t", "symbol", "cdf" if shared is None else "model")
    return rows.groupBy(*keys).applyInArrow(run, f"{_types(sequences, keys)}, payload binary, symbols long, wide boolean")


def decode(payloads: DataFrame, models: DataFrame, tables: DataFrame | None = None, *, keys: tuple = ("track",), bits: int = BITS, limit: int = 16_384) -> DataFrame:
    """(keys, t, symbol) from (keys, payload) and the same models (keys, t, cdf or model); keys without a payload give nothing."""
    shared = shared_tables(tables, limit)

    def run(table: pa.Table, payload: pa.Table) -> pa.Table:
        if not payload.num_rows:
            table = table.slice(0, 0)
        table = table.sort_by("t")
        symbols = decode_symbols(payload.column("payload")[0].as_py(), _counts(table, shared), bits) if table.num_rows else []
        return pa.table({**{k: table.column(k) for k in keys}, "t": table.column("t").cast(pa.int64()), "symbol": pa.array(symbols, pa.int64())})

    rows = models.select(*keys, "t", "cdf" if shared is None else "model").groupBy(*keys)
    return rows.cogroup(payloads.select(*keys, "payload").groupBy(*keys)).applyInArrow(run, f"{_types(models, keys)}, t long, symbol long")
