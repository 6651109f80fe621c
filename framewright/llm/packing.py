"""Best-fit packing of token sequences by hierarchical residual packing.

Texts are tokenized where they lie; the descriptions of their pieces (no token ids) are spread by hash, so that each partition has
its share of every length, however the table is sorted. Each partition packs its own best-fit (longest first) and emits the bins that are nearly
full. Underfull bins become items themselves, of the partition's next lot of pieces first; then a tree of groups of partitions merges them, best-fit again, level by level, until one
group is left. A node passes on at most ``carry`` underfull bins (the emptiest; the fuller rest is final), so no task's work grows with the
corpus; best fit leaves at most one bin of a run half empty or more, so what is closed at a node is more than half full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, documents, partition_id, written
from .tokenizing import encoder, vocabulary_path

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, node long, length int, final boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
NAMES = ["bin", "node", "length", "final", "members"]


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, longest item first, each into the fullest bin that still takes it.

    Bins of equal residual stand on one stack, and an integer's set bits say which residuals have bins:
    the lowest set bit from the item's length up is the best fit.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    having, bins, out = 0, 0, np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = having >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                having ^= 1 << room
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        if room > n:
            stacks[room - n].append(b)
            having |= 1 << (room - n)
    return out


def _pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items in bin order, edges of the bins in them, bin lengths, item offsets in their bins)."""
    where = best_fit(lengths, capacity)
    order = np.argsort(where, kind="stable")
    n = lengths[order]
    edges = np.concatenate([np.flatnonzero(np.diff(where[order], prepend=-1)), [len(order)]])
    before = np.cumsum(n) - n
    starts = edges[:-1]
    sums = np.add.reduceat(n, starts) if len(n) else n
    return order, edges, sums, before - np.repeat(before[starts] if len(n) else before, np.diff(edges))


def _joined(lengths: np.ndarray, members: pa.ListArray, capacity: int) -> tuple[np.ndarray, pa.ListArray]:
    """Bins packed into fuller ones: lengths and members of these, each member's offset moved to its new place."""
    order, edges, sums, shift = _pack(lengths, capacity)
    members = members.take(pa.array(order))
    inside = np.asarray(members.offsets).astype(np.int64)
    inside, flat = inside - inside[0], members.flatten()
    moved = pa.array(np.asarray(flat.field("offset")) + np.repeat(shift, np.diff(inside)))
    flat = pa.StructArray.from_arrays([flat.field(f.name) if f.name != "offset" else moved for f in MEMBER], fields=list(MEMBER))
    return sums, pa.ListArray.from_arrays(pa.array(inside[edges], pa.int32()), flat)


def _batch(bins, node, lengths, final, members):
    return pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(np.full(len(bins), node), pa.int64()), pa.array(lengths, pa.int32()), pa.array(final, pa.bool_()), members], names=NAMES)


def _keep(lengths: np.ndarray, full: int, carry: int, last: bool) -> np.ndarray:
    """Which bins are final: nearly full ones, those beyond the ``carry`` emptiest, and all at the root."""
    final = np.full(len(lengths), last) | (lengths >= full)
    rest = np.flatnonzero(~final)
    if len(rest) > carry:
        final[rest[np.argsort(lengths[rest], kind="stable")[carry:]]] = True
    return final


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text",
    slack: int = 16, fan_in: int = 16, carry: int = 4096, chunk: int = 100_000,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only longer ones are cut, into ``capacity``-token pieces. A null
    text is empty (one token). Repeated rows are packed as often as they stand; null doc_ids stay null. Other
    columns are ignored, and an empty table gives no rows. ``slack``: bins with at most that much room are final.
    """

    def describe(iterator):
        coder = encoder(tokenizer)
        for batch in batches(iterator, "text", 4 << 20, tokenizing=True):
            flat, offsets = coder.encode(batch.column(1), end_id)
            size = np.diff(offsets)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            raw = memoryview(flat.tobytes())
            a = (offsets[row] + start) * 4
            crc = np.array([zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist())], np.int64)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def local(iterator):
        node, made, held, count = partition_id(), 0, [], 0
        open_lengths, open_members = np.zeros(0, np.int64), pa.array([], pa.list_(MEMBER))

        def batch_of(lengths, members, final):
            nonlocal made
            ids = (np.int64(node) << 32) + made + np.arange(len(lengths))
            made += len(lengths)
            return _batch(ids, node, lengths, np.full(len(lengths), final), members)

        def flush():
            """Packs what is held, and then its bins with those left open before; gives the final ones."""
            nonlocal held, count, open_lengths, open_members
            table = pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
            order, edges, sums, offset = _pack(table.column("length").to_numpy().astype(np.int64), capacity)
            arrays = [c.combine_chunks() for c in table.take(pa.array(order)).columns]
            members = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([*arrays, pa.array(offset)], fields=list(MEMBER)))
            if len(open_lengths):
                sums, members = _joined(np.concatenate([open_lengths, sums]), pa.concat_arrays([open_members, members.cast(open_members.type)]), capacity)
            final = _keep(sums, capacity - slack, carry, False)
            open_lengths, open_members = sums[~final], members.filter(pa.array(~final))
            return batch_of(sums[final], members.filter(pa.array(final)), True)

        for batch in iterator:
            held.append(batch)
            count += batch.num_rows
            if count >= chunk:
                yield flush()
        if count:
            yield flush()
        yield batch_of(open_lengths, open_members, False)

    def merge(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("bin").combine_chunks()
            node = table.column("node")[0].as_py()
            members = table.column("members").combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            sums, members = _joined(table.column("length").to_numpy().astype(np.int64), members, capacity)
            final = _keep(sums, capacity - slack, carry, last)
            ids = (np.int64(level) << 56) + (np.int64(node) << 32) + np.arange(len(sums))
            return pa.Table.from_batches([_batch(ids, node, sums, final, members)])

        return run

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spread = rows.mapInArrow(describe, PIECES).repartition("doc_id", "piece", "ids_crc32")
    bins = written(spread.mapInArrow(local, BINS), "packed-0")
    done, open_ = [bins.where("final")], bins.where(~F.col("final"))
    level = 0
    nodes = (bins.agg(F.max("node")).head()[0] or 0) + 1
    while True:
        level, nodes = level + 1, -(-nodes // fan_in)
        grouped = open_.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).groupBy("node")
        bins = written(grouped.applyInArrow(merge(level, nodes == 1), BINS), f"packed-{level}")
        done.append(bins.where("final"))
        open_ = bins.where(~F.col("final"))
        if nodes == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("sequence_id"), F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in 4,096-token sequences."""
    return pack_documents(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))
