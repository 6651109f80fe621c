"""Token-id files: bit-plane shuffled, zstandard-compressed chunks behind a chunk index.

A file holds whole documents in ascending id order. Layout, little-endian throughout (fixed format)::

    "FWTB" · version u8 · plane mode u8 (0 byte planes, 1 bit planes) · id width u8 (bytes) · 0 · chunk ids u32
    chunk*:   its planes, low plane first, each one zstandard frame
    index:    zstandard frame of  n_docs u64 · doc ids i64[] · doc null flags u8[] · doc sizes u32[]
              n_chunks u64 · per chunk: offset u64 · n ids u32 · crc32 of the ids u32 · plane sizes u32[planes]
    index offset u64 · index size u32 · "FWTB"

A chunk is ``chunk_ids`` ids (the last one fewer), cut without regard to documents, so any id range is read
by opening the index and the chunks that overlap it. Files are bounded by ``file_ids``: a document that is
longer makes a file of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, documents, partition_id, shared_dir, write_file, written
from .tokenizing import encoder, vocabulary_path

MAGIC, VERSION = b"FWTB", 1  # fixed values of the format
HEAD, TAIL = struct.Struct("<4sBBBxI"), struct.Struct("<QI4s")
MODES = ("byte", "bit")


def split_planes(ids: np.ndarray, mode: str = "byte") -> list:
    """The ids' planes, low plane first: bytes of equal weight, or bits of equal weight packed eight to a byte."""
    width = ids.dtype.itemsize
    octets = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    if mode == "byte":
        return [octets[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def join_planes(planes: list, n: int, width: int, mode: str = "byte") -> np.ndarray:
    """The inverse of :func:`split_planes`."""
    if mode == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view(f"<u{width}").reshape(-1)


def encode_file(doc_ids: list, ids: list, chunk_ids: int = 1 << 16, mode: str = "byte", level: int = 1) -> bytes:
    """One file of the documents' id arrays."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype("<u4", copy=False)
    out, at, chunks = [HEAD.pack(MAGIC, VERSION, MODES.index(mode), 4, chunk_ids)], HEAD.size, []
    for k in range(0, len(flat), chunk_ids):
        part = flat[k : k + chunk_ids]
        planes = [press(p) for p in split_planes(part, mode)]
        chunks.append(struct.pack("<QII", at, len(part), zlib.crc32(part.tobytes())) + np.array([len(p) for p in planes], "<u4").tobytes())
        out += planes
        at += sum(map(len, planes))
    index = struct.pack("<Q", len(ids)) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    index = press(index + np.array([len(x) for x in ids], "<u4").tobytes() + struct.pack("<Q", len(chunks)) + b"".join(chunks))
    return b"".join([*out, index, TAIL.pack(at, len(index), MAGIC)])


class TokenFile:
    """Reader over a file's bytes: document table, chunk index, any id range. Raises ValueError if damaged."""

    def __init__(self, blob: bytes):
        import zstandard

        if len(blob) < HEAD.size + TAIL.size or blob[:4] != MAGIC or blob[-4:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        _, version, mode, self.width, self.chunk_ids = HEAD.unpack_from(blob)
        if version != VERSION:
            raise ValueError(f"version {version} is unknown")
        self.blob, self.mode, self._open = blob, MODES[mode], zstandard.ZstdDecompressor().decompress
        at, size, _ = TAIL.unpack_from(blob, len(blob) - TAIL.size)
        index = self._open(blob[at : at + size])
        (n,) = struct.unpack_from("<Q", index)
        nulls = np.frombuffer(index, np.uint8, n, 8 + 8 * n)
        self.doc_ids = [None if null else d for d, null in zip(np.frombuffer(index, "<i8", n, 8).tolist(), nulls)]
        self.sizes = np.frombuffer(index, "<u4", n, 8 + 9 * n).astype(np.int64)
        at = 8 + 13 * n
        (m,) = struct.unpack_from("<Q", index, at)
        planes = self.width * (8 if self.mode == "bit" else 1)
        row = np.dtype([("at", "<u8"), ("n", "<u4"), ("crc", "<u4"), ("sizes", "<u4", (planes,))])
        self.chunks = np.frombuffer(index, row, m, at + 8)

    def chunk(self, k: int) -> np.ndarray:
        c, planes = self.chunks[k], []
        at = int(c["at"])
        for size in c["sizes"].tolist():
            planes.append(self._open(self.blob[at : at + size]))
            at += size
        ids = join_planes(planes, int(c["n"]), self.width, self.mode)
        if zlib.crc32(ids.tobytes()) != int(c["crc"]):
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start .. stop of the file; only the chunks that hold them are opened."""
        total = int(self.sizes.sum())
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, f"<u{self.width}")
        first = start // self.chunk_ids
        got = np.concatenate([self.chunk(k) for k in range(first, -(-stop // self.chunk_ids))])
        return got[start - first * self.chunk_ids : stop - first * self.chunk_ids]


MANIFEST = "file string, part int, seq int, first_doc long, n_docs long, n_ids long, n_bytes long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1,
    chunk_ids: int = 1 << 16, file_ids: int = 1 << 22, mode: str = "byte", level: int = 1,
) -> DataFrame:
    """Tokenize every whole text and write token files to ``folder`` in ascending id order; returns the manifest.

    One range shuffle by id puts the documents in order; each task then tokenizes and writes as it streams,
    holding one file at most. Null texts are empty documents, null ids come first, repeated ids stay as they
    are (ordered by text). Columns other than the two named are ignored; an empty table gives no file. Files have names that depend on their
    place alone and are renamed into place, so a task that runs again writes the same files.
    """

    def write(iterator):
        coder, part, seq = encoder(tokenizer), partition_id(), 0
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal doc_ids, ids, held, seq
            name = f"part-{part:06d}-{seq:04d}.fwtb"
            write_file(f"{folder}/{name}", blob := encode_file(doc_ids, ids, chunk_ids, mode, level))
            row = [name, part, seq, doc_ids[0], len(ids), held, len(blob)]
            doc_ids, ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4))], names=["file", "part", "seq", "first_doc", "n_docs", "n_ids", "n_bytes"])

        for batch in batches(iterator, "text", 4 << 20, tokenizing=True):
            flat, offsets = coder.encode(batch.column(1), end_id)
            for d, a, b in zip(batch.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                if held and held + b - a > file_ids:
                    yield flush()
                doc_ids.append(d)
                ids.append(flat[a:b].copy())
                held += b - a
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark, folder: str, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids before it over all files), n_tokens, ids_crc32, file; ids if asked for.

    Files are read by Spark (any store it reads), a file to a row; their sizes are bounded by the writer.
    ``start`` adds the running sum of the manifest, which has one row a file.
    """
    schema = "file string, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(iterator):
        for batch in iterator:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = TokenFile(blob.as_py())
                flat, stops = f.ids(), np.cumsum(f.sizes)
                raw, edges = memoryview(flat.tobytes()), (4 * np.concatenate([[0], stops])).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])]
                columns = [pa.array([path.rsplit("/", 1)[-1]] * len(crc)), pa.array(f.doc_ids, pa.int64()), pa.array(stops - f.sizes), pa.array(f.sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype("i4")), pa.array(flat.astype("i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    if not manifest.head(1):
        return spark.createDataFrame([], schema)
    base = manifest.select("file", (F.sum("n_ids").over(W.orderBy("part", "seq")) - F.col("n_ids")).alias("base"))
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.fwtb").load(folder).select("path", "content").mapInArrow(read, schema)
    return rows.join(base, "file").withColumn("start", F.col("start") + F.col("base")).drop("base")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back: doc_id, start, n_tokens, ids_crc32, file."""
    folder = shared_dir(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), folder, vocabulary_path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "file")
