"""Tensor files as tables: weight files of one fixed order, and archives that begin with a JSON head.

Reading is a data source: it opens the heads, deals rows of the wanted tensors to tasks by their size in bytes, and a task reads its own ranges
alone. A row is a row of a tensor's first axis;
one of a single axis comes in pieces of ``PIECE`` values, ``row`` being the first's place.

Writing (archives, weights) lays tensors out by sums of their sizes and hands the pieces to :mod:`.ranges`.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ranges

NAME = "tensor_file"
PIECE = 1 << 16

#: Fixed values of the formats: how weight files begin, and the archive's types.
PLAIN, QUANTISED, HEAD_BYTES = b"ELMW0001", b"ELMQ0001", 36
DIMENSIONS = ("dim", "layers", "heads", "codebooks", "cardinality", "frame_length", "past_context")
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "?"}

SCHEMA = "path string, name string, dtype string, shape array<bigint>, row bigint, scale float, data binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("row", pa.int64()), ("scale", pa.float32()), ("data", pa.binary()), ("error", pa.string())])


@dataclass(frozen=True)
class Tensor:
    """Where a tensor stands in its file. ``scales``: where the scale of each row does, if it has them."""

    name: str
    dtype: str
    shape: tuple
    at: int
    scales: int | None = None

    @property
    def width(self) -> int:
        return np.dtype(TYPES[self.dtype]).itemsize

    @property
    def size(self) -> int:
        return prod(self.shape) * self.width

    @property
    def row_values(self) -> int:
        return prod(self.shape[1:]) if len(self.shape) > 1 else min(PIECE, prod(self.shape))

    @property
    def rows(self) -> int:
        """How many rows (or pieces of a single axis) it is read in."""
        return self.shape[0] if len(self.shape) > 1 else -(-prod(self.shape) // PIECE)


def weight_shapes(dims: dict) -> list[tuple[str, tuple, bool]]:
    """(name, shape, whether rows are quantised) of a weight file's tensors in their order."""
    d, h = dims["dim"], 4 * dims["dim"]
    out = [("norm_in.weight", (d,), False), ("norm_in.bias", (d,), False), ("pos_emb", (dims["frame_length"], d), False)]
    for k in range(dims["layers"]):
        for part, rows, cols in (("in_proj", 3 * d, d), ("out_proj", d, d), ("linear1", h, d), ("linear2", d, h)):
            out += [(f"layers.{k}.{part}.weight", (rows, cols), True), (f"layers.{k}.{part}.bias", (rows,), False)]
        out += [(f"layers.{k}.{part}.{what}", (d,), False) for part in ("norm1", "norm2") for what in ("weight", "bias")]
    out += [(f"emb.{k}", (dims["cardinality"] + 1, d), False) for k in range(dims["codebooks"])]
    for k in range(dims["codebooks"]):
        out += [(f"linears.{k}.weight", (dims["cardinality"], d), True), (f"linears.{k}.bias", (dims["cardinality"],), False)]
    return out


def check_dimensions(dims: dict) -> None:
    if not all(dims[k] for k in ("dim", "layers", "heads", "codebooks", "cardinality")):
        raise ValueError("weight file with a dimension of zero")
    if dims["dim"] % dims["heads"]:
        raise ValueError(f"dimension {dims['dim']} isn't divisible by {dims['heads']} heads")


def weight_layout(dims: dict, quantised: bool) -> tuple[list[Tensor], int]:
    """The tensors of a weight file and its size. Quantised rows are int8 after the scales of all rows."""
    at, out = HEAD_BYTES, []
    for name, shape, rows in weight_shapes(dims):
        if quantised and rows:
            out.append(Tensor(name, "I8", shape, at + 4 * shape[0], at))
            at += 4 * shape[0] + prod(shape)
        else:
            out.append(Tensor(name, "F32", shape, at))
            at += 4 * prod(shape)
    return out, at


def archive_layout(head: bytes, begin: int, size: int) -> list[Tensor]:
    """The tensors of an archive's JSON head; ValueError unless they are well-formed, named once and end where the file does."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a name stands twice in the head")
        return dict(pairs)

    out, end = [], 0
    for name, entry in json.loads(head, object_pairs_hook=once).items():
        if name == "__metadata__":
            continue
        try:
            (start, stop), dtype, shape = entry["data_offsets"], entry["dtype"], tuple(entry["shape"])
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"tensor {name} isn't described") from e
        if dtype not in TYPES:
            raise ValueError(f"type {dtype} of {name} isn't known")
        if start < 0 or stop < start:
            raise ValueError(f"places {start} to {stop} of {name} are no range")
        tensor = Tensor(name, dtype, shape, begin + start)
        if tensor.size != stop - start:
            raise ValueError(f"{name} has {stop - start} bytes, its shape needs {tensor.size}")
        out.append(tensor)
        end = max(end, stop)
    if begin + end != size:
        raise ValueError(f"file of {size} bytes, its head says {begin + end}")
    return sorted(out, key=lambda t: t.at)


def layout_of(file, size: int) -> list[Tensor]:
    """The tensors of an open file, from its head alone; ValueError says what is wrong with it."""
    start = file.read_at(min(size, HEAD_BYTES), 0)
    if start[:8] in (PLAIN, QUANTISED):
        if size < HEAD_BYTES:
            raise ValueError("weight file ends early")
        dims = dict(zip(DIMENSIONS, struct.unpack("<7I", start[8:HEAD_BYTES])))
        check_dimensions(dims)
        tensors, end = weight_layout(dims, start[:8] == QUANTISED)
        if size < end:
            raise ValueError("weight file ends early")
        if size > end:
            raise ValueError(f"weight file has {size - end} trailing bytes")
        return tensors
    if size < 8 or (n := struct.unpack("<Q", start[:8])[0]) > size - 8:
        raise ValueError("neither a weight file nor an archive")
    try:
        return archive_layout(file.read_at(n, 8), 8 + n, size)
    except UnicodeDecodeError as e:
        raise ValueError("neither a weight file nor an archive") from e


@dataclass
class _Ranges(InputPartition):
    path: str
    parts: list  # (tensor, first row, row after the last)
    error: str | None = None

    @property
    def size(self) -> int:
        return sum((b - a) * t.row_values * t.width + (4 * (b - a) if t.scales is not None else 0) for t, a, b in self.parts)


class TensorFile(DataSource):
    """Options: ``path`` (a file or a folder of files), ``bytes``: about how many a task reads (32 MB), ``names`` (a JSON list) and ``prefix``: which tensors."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        names = self.options.get("names")
        return _Reader(self.options["path"], int(self.options.get("bytes", 1 << 25)), None if names is None else set(json.loads(names)), self.options.get("prefix", ""))


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int, names: set | None = None, prefix: str = ""):
        self.path, self.limit, self.names, self.prefix = path, limit, names, prefix

    def _wanted(self, name: str) -> bool:
        return (self.names is None or name in self.names) and name.startswith(self.prefix)

    def partitions(self):
        from pyarrow import fs

        disk, path = ranges.store(self.path)
        info = disk.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in disk.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        out = []
        for found in files:
            try:
                with disk.open_input_file(found.path) as file:
                    tensors = layout_of(file, found.size)
            except ValueError as e:
                out.append(_Ranges(found.path, [], str(e)))
                continue
            held = _Ranges(found.path, [])
            for t in tensors:
                step = max(1, self.limit // max(1, t.row_values * t.width))
                for a in range(0, t.rows, step) if self._wanted(t.name) else ():
                    part = (t, a, min(t.rows, a + step))
                    if held.parts and held.size + _Ranges("", [part]).size > self.limit:
                        out.append(held)
                        held = _Ranges(found.path, [])
                    held.parts.append(part)
            if held.parts:
                out.append(held)
        return out or [_Ranges("", [])]

    def read(self, partition: _Ranges):
        if partition.error is not None:
            yield pa.RecordBatch.from_pylist([{"path": partition.path, "error": partition.error}], schema=_ARROW)
            return
        if not partition.parts:
            return
        disk, _ = ranges.store(self.path)
        with disk.open_input_file(partition.path) as file:
            for t, a, b in partition.parts:
                row = t.row_values * t.width
                stop = min(t.size, b * row)
                data = file.read_at(stop - a * row, t.at + a * row)
                scales = np.frombuffer(file.read_at(4 * (b - a), t.scales + 4 * a), "<f4") if t.scales is not None else None
                first = np.arange(a, b) * (t.row_values if len(t.shape) < 2 else 1)
                n = b - a
                columns = [pa.array([partition.path] * n), pa.array([t.name] * n), pa.array([t.dtype] * n), pa.array([list(t.shape)] * n, pa.list_(pa.int64())), pa.array(first, pa.int64())]
                columns += [pa.array(scales, pa.float32()) if scales is not None else pa.nulls(n, pa.float32()), pa.array([data[k * row : (k + 1) * row] for k in range(n)], pa.binary()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def read(spark: SparkSession, path: str, names: list | None = None, prefix: str = "", bytes_a_task: int = 1 << 25) -> DataFrame:
    """(path, name, dtype, shape, row, scale, data, error): rows of every tensor, or of those of some ``names`` or a ``prefix`` alone.

    Other tensors' bytes aren't read. A file that can't be read gives one row with its ``error``. Which tensors is an option of the reader and
    not a pushed-down filter: Spark shares such a reader among all uses of a table in a plan, so two uses with two filters would both get one's rows.
    """
    spark.dataSource.register(TensorFile)
    reader = spark.read.format(NAME).option("path", path).option("bytes", bytes_a_task).option("prefix", prefix)
    return (reader if names is None else reader.option("names", json.dumps(names))).load()


def values(rows: DataFrame) -> DataFrame:
    """(path, name, row, scale, v) of rows that were read: their values as doubles, quantised ones as whole numbers beside their scale."""

    def run(iterator):
        for batch in iterator:
            v = [np.frombuffer(d, TYPES[t]).astype(np.float64) for t, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(v, pa.list_(pa.float64()))], names=["path", "name", "row", "scale", "v"])

    sound = rows.where(F.col("error").isNull())
    return sound.select("path", "name", "row", "scale", "dtype", "data").mapInArrow(run, "path string, name string, row long, scale float, v array<double>")


def pack(rows: DataFrame) -> DataFrame:
    """``rows`` with ``data``, the bytes of the array ``v`` as numbers of type ``dtype``."""
    names = [c for c in rows.columns if c not in ("v", "dtype", "data")]

    def run(iterator):
        for batch in iterator:
            n = len(names)
            data = [None if v is None else np.asarray(v.values).astype(TYPES[t]).tobytes() for v, t in zip(batch.column(n), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 1), pa.array(data, pa.binary())], names=[*names, "dtype", "data"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "v", "dtype").mapInArrow(run, f"{kinds + ', ' if names else ''}dtype string, data binary")


def archives(rows: DataFrame, folder: str, keep, metadata: dict | None = None) -> DataFrame:
    """(name, bytes, digest, error) of archives in ``folder`` from (archive, name, place, dtype, row_shape, row, data).

    A row is a row of a tensor's first axis, from 0; where ``row_shape`` is null the tensor has a single axis and a row is a piece
    of it, ``row`` being its first value's place (as :func:`read` gives them). Tensors stand in the order of ``place``: their offsets are sums of the
    sizes before, rows' places follow from their numbers. The head is filled with spaces to a multiple of 8. A name with two places, types or
    shapes, and a row of another size than its shape, are errors; missing and repeated rows are the file's ``error``.
    """
    item = F.element_at(F.create_map(*[F.lit(x) for t, k in TYPES.items() for x in (t, np.dtype(k).itemsize)]), F.col("dtype")).cast("long")
    size, flat = F.octet_length("data").cast("long"), F.col("row_shape").isNull()
    fits = F.when(flat, size % item == 0).otherwise(size == item * F.aggregate("row_shape", F.lit(1).cast("long"), lambda s, x: s * x))
    refuse = lambda why: F.raise_error(F.concat("name", F.lit(why))).cast("long")
    checked = rows.withColumn("size", F.when(fits, size).otherwise(refuse(" has a row of another size than its shape"))).withColumn("item", item)
    same = F.lit(True)
    for c in ("place", "dtype", "row_shape"):
        same = same & F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1)))
    first = [F.first(c).alias(c) for c in ("place", "dtype", "row_shape", "item")]
    tensors = checked.groupBy("archive", "name").agg(*first, F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), same.alias("same"))
    tensors = tensors.withColumn("bytes", F.when(F.col("same"), F.col("bytes")).otherwise(refuse(" is in the archive twice")))
    before = Window.partitionBy("archive").orderBy("place", "name").rowsBetween(Window.unboundedPreceding, -1)
    tensors = keep(tensors.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))))

    shape = F.when(flat, F.array((F.col("bytes") / F.col("item")).cast("long"))).otherwise(F.concat(F.array("rows"), "row_shape"))
    name = F.regexp_extract(F.to_json(F.struct("name")), r'^\{"name":(.*)\}$', 1)
    line = F.concat(name, F.lit(":"), F.to_json(F.struct("dtype", shape.alias("shape"), F.array("offset", F.col("offset") + F.col("bytes")).alias("data_offsets"))))
    heads = tensors.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "place", line.alias("line")))).alias("x"))
    more = [F.array(F.lit('"__metadata__":' + json.dumps(metadata, separators=(",", ":"))))] if metadata else []
    text = F.concat(F.lit("{"), F.array_join(F.concat(*more, F.transform("x", lambda e: e["line"])), ","), F.lit("}")).cast("binary")
    heads = heads.select("archive", text.alias("json")).withColumn("json", F.concat("json", F.expr("cast(repeat(' ', pmod(-octet_length(json), 8)) AS binary)")))
    big = F.lpad(F.hex(F.octet_length("json")), 16, "0")
    little = F.unhex(F.concat(*(F.substring(big, k, 2) for k in range(15, 0, -2))))
    heads = keep(heads.select("archive", F.concat(little, "json").alias("head")))

    placed = checked.join(tensors.select("archive", "name", "offset"), ["archive", "name"]).join(heads.select("archive", F.octet_length("head").cast("long").alias("begin")), "archive")
    at = F.col("begin") + F.col("offset") + F.col("row") * F.when(flat, F.col("item")).otherwise(F.col("size"))
    pieces = placed.select(F.col("archive").alias("name"), at.alias("at"), "data")
    return ranges.write(pieces.union(heads.select("archive", F.lit(0).cast("long"), "head")), folder, keep)


def weights(rows: DataFrame, dims: dict, folder: str, file: str, keep, quantised: bool = False) -> DataFrame:
    """(name, bytes, digest, error) of a weight file from (name, row, data) and, of quantised rows, ``scale``.

    Rows of a tensor with two axes, or the whole of one with a single axis (row 0); a missing or repeated row is the error. A tensor's
    places follow from the dimensions, so rows are placed by a join with a table of tensors.
    """
    check_dimensions(dims)
    spark = rows.sparkSession
    tensors, end = weight_layout(dims, quantised)
    table = [(t.name, t.at, t.width * (t.row_values if len(t.shape) > 1 else prod(t.shape)), t.scales) for t in tensors]
    table = F.broadcast(spark.createDataFrame(table, "name string, begin long, width long, scales long"))
    placed = rows.join(table, "name")
    fits = F.when(F.octet_length("data") == F.col("width"), F.col("data")).otherwise(F.raise_error(F.concat("name", F.lit(" has a row of another size"))).cast("binary"))
    out = placed.select(F.lit(file).alias("name"), (F.col("begin") + F.col("row") * F.col("width")).alias("at"), fits.alias("data"))
    if quantised:
        four = pack(placed.where(F.col("scales").isNotNull()).select((F.col("scales") + 4 * F.col("row")).alias("at"), F.array("scale").alias("v"), F.lit("F32").alias("dtype")))
        out = out.union(four.select(F.lit(file), "at", "data"))
    magic = (QUANTISED if quantised else PLAIN) + struct.pack("<7I", *(dims[k] for k in DIMENSIONS))
    head = spark.range(1).select(F.lit(file).alias("name"), F.lit(0).cast("long").alias("at"), F.lit(magic).alias("data"))
    made = ranges.write(out.union(head), folder, keep)
    return made.withColumn("error", F.coalesce("error", F.when(F.col("bytes") != end, "weight file ends early")))
