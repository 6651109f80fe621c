"""Repeated passages removed by suffix automata over shards of reference text.

A window is ``window`` consecutive words. Every window has an anchor, the lowest-ranked k-gram in it, so equal windows
have equal anchors wherever they stand; a run of windows with one anchor is a piece. Pieces of an anchor that
several documents share are the reference text: they are dealt to shards by anchor, each shard builds suffix
automata of its distinct pieces, whose states know the smallest document they occur in, and the documents'
pieces stream through them. Matching statistics of at least ``window`` words whose first document is smaller
mark the words to go.

K-grams that are frequent in the whole corpus rank last (a sketch of fixed size says which), so a window
that reaches beyond a common passage is anchored outside it and no shard gathers all its surroundings.
Where an anchor still has many pieces, they are cut into windows, dealt to as many shards as it takes by the windows'
hashes: equal windows meet, and the work grows with the pieces, not with their square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, documents, sheltered, span_hashes, spent, written

SEGMENT = 1 << 20  # windows of a document that are ranked at once


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``first[state]`` is the smallest id its strings occur under.

    Sequences are added in ascending id order; ids are any comparable values.
    """

    __slots__ = ("first", "length", "link", "next")

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def _state(self, length, edges, link):
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        return len(self.next) - 1

    def _split(self, p, word, q):
        """A state for the strings of q that end at p's length + 1; edges that led there are moved to it."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.first[copy] = self.first[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, owner) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            p = last
            while p > 0 and self.first[p] is None:  # owners ascend: a state that has one keeps it
                self.first[p] = owner
                p = link[p]

    def matches(self, words: list, least: int):
        """(end, first owner) of each place where at least ``least`` words before ``end`` occur in the reference."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for end, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            q = nexts[state].get(word)
            if q is None:
                state = size = 0
                continue
            state, size = q, size + 1
            if size >= least:
                up = state
                while length[link[up]] >= least:
                    up = link[up]
                yield end, first[up]


def _lowest(rank: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, by doubling."""
    span = 1
    while 2 * span <= width:
        rank = np.minimum(rank[:-span], rank[span:])
        span *= 2
    return np.minimum(rank[: len(rank) - (width - span)], rank[width - span :]) if width > span else rank


def _kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(max(0, len(hashes) - k + 1))
    return span_hashes(hashes, at, at + k)


def remove_repeated(
    docs: DataFrame, *, window: int = 50, k: int = 8, slots: int = 1 << 20, block: int = 1024, doc_id: str = "doc_id", text: str = "text", carry: bool = False,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, text (kept words joined by one space), n_words, n_removed, spans.

    ``spans`` are the maximal removed runs as (first word, words). A word goes if a window over it has a word
    sequence that also starts in a document with a smaller doc_id; windows are judged on the input. Words
    are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; null and empty texts have none, and texts of
    fewer words than the window lose none. Rows that share a doc_id (repeated rows) aren't smaller than each other; rows without a
    doc_id take no part. Other columns are ignored, or with ``carry`` kept beside __text, __n_words, __n_removed, __spans.
    """
    reach = window - k + 1

    def frequent(iterator):
        """Slots that hold over twice the mean of this task's k-grams; slot -1: all k-grams."""
        counts, total = np.zeros(slots, np.int64), 0
        for batch in batches(iterator, "text"):
            words = Words(batch.column(0))
            grams = _kgrams(words.hashes, k)
            counts += np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
            total += len(grams)
        often = np.flatnonzero(counts > max(8, 2 * total / slots))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1), pa.int32()), pa.array(np.append(counts[often], total))], names=["slot", "n"])

    def anchored(common):
        def run(iterator):
            hot = np.unpackbits(common.value)
            for batch in batches(iterator, "text"):
                words, columns = Words(batch.column(2)), []
                grams = _kgrams(words.hashes, k)
                late = hot[(grams & np.uint64(slots - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
                rank = late | ((grams >> np.uint64(22)) << np.uint64(21))
                for row, (a, b) in enumerate(words.rows()):
                    for s in range(a, b - window + 1, SEGMENT):
                        n = min(SEGMENT, b - window + 1 - s)
                        low = _lowest(rank[s : s + n + reach - 1] | np.arange(n + reach - 1, dtype=np.uint64), reach)
                        place = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
                        at = np.flatnonzero(np.diff(place, prepend=-1))
                        runs = np.diff(np.append(at, n))
                        columns.append((np.full(len(at), row), s + at, runs, grams[s + place[at]], np.full(len(at), a)))
                if columns:
                    row, at, runs, anchor, origin = (np.concatenate(c) for c in zip(*columns))
                    piece = span_hashes(words.hashes, at, at + runs + window - 1)
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array((at - origin).astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))], names=["doc_id", "tag", "at", "n", "anchor", "piece"])

        return run

    def cut(iterator):
        """The words of the wanted pieces, as hashes; pieces of an anchor of several parts window by window, each in its hash's part."""
        for batch in batches(iterator, "text"):
            words, want = Words(batch.column(1)), batch.column(2)
            edges = np.asarray(want.offsets).astype(np.int64)
            flat = want.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            at = np.asarray(flat.field("at")).astype(np.int64) + words.edges[row]
            n, parts = np.asarray(flat.field("n")).astype(np.int64), np.asarray(flat.field("parts")).astype(np.int64)
            times = np.where(parts > 1, n, 1)
            pick = np.repeat(np.arange(len(at)), times)
            off = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            a = at[pick] + off
            b = np.where(parts[pick] > 1, a + window, at[pick] + n[pick] + window - 1)
            part = (span_hashes(words.hashes, a, b) % parts[pick].astype(np.uint64)).astype(np.int32)
            raw = words.hashes.view(np.uint8).tobytes()
            values = [raw[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist())]
            taken = pa.array(pick)
            yield pa.RecordBatch.from_arrays([flat.field("anchor").take(taken), pa.array(part), batch.column(0).take(pa.array(row[pick])), flat.field("piece").take(taken), pa.array(off.astype(np.int32)), pa.array(values, pa.binary())], names=["anchor", "part", "first_doc", "piece", "off", "words"])

    def shards(iterator):
        """Runs of windows of each streamed piece and the first reference document that has them.

        Pieces come in the order of their documents, so what the automaton holds when a piece streams through is all
        that can be earlier: only the automaton of one shard is held.
        """
        automaton = key = None
        for batch in iterator:
            out = []
            numbers = [batch.column(c).to_pylist() for c in range(5)]
            for anchor, part, doc, piece, off, words in zip(*numbers, batch.column(5)):
                if (anchor, part) != key:
                    automaton, key = SuffixAutomaton(), (anchor, part)
                words = np.frombuffer(words.as_buffer(), np.uint64).tolist()
                automaton.add(words, doc)
                start = size = 0
                owner = None
                for end, first in automaton.matches(words, window):
                    if first != owner or end - window != start + size:
                        if size:
                            out.append((anchor, piece, off + start, size, owner))
                        start, size, owner = end - window, 0, first
                    size += 1
                if size:
                    out.append((anchor, piece, off + start, size, owner))
            yield _runs(out)

    def _runs(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "piece", "off", "len", "owner"])

    def strip(iterator):
        for batch in batches(iterator, "__text"):
            words, spans = Words(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1)
            edges = np.asarray(spans.offsets).astype(np.int64)
            flat = spans.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            a = np.asarray(flat.field("at")).astype(np.int64) + words.edges[row]
            total = len(words.starts)
            depth = np.zeros(total + 1, np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, a + np.asarray(flat.field("n")) + window - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            raw, removed = words.data.tobytes(), np.concatenate([[0], np.cumsum(gone)])
            texts, cuts = [], []
            starts, stops = words.starts.tolist(), words.stops.tolist()
            for (x, y), (p, q) in zip(words.rows(), zip(words.bounds.tolist(), words.bounds[1:].tolist())):
                if removed[y] == removed[x]:
                    texts.append(b" ".join(raw[p:q].split()).decode("utf-8", "replace"))
                    cuts.append([])
                    continue
                kept = np.flatnonzero(~gone[x:y]) + x
                texts.append(b" ".join([raw[starts[w] : stops[w]] for w in kept.tolist()]).decode("utf-8", "replace"))
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone[x:y], [False]]).astype(np.int8)))
                cuts.append(list(zip(turn[::2].tolist(), (turn[1::2] - turn[::2]).tolist())))
            edges, count = words.edges, batch.num_columns - 2
            spans = pa.array([[{"at": p, "words": q} for p, q in c] for c in cuts], pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64())])))
            columns = [*batch.columns[:count], pa.array(texts, pa.string()), pa.array(np.diff(edges)), pa.array(removed[edges[1:]] - removed[edges[:-1]]), spans]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:count], "__text", "__n_words", "__n_removed", "__spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    counts = rows.select("text").mapInArrow(frequent, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()  # at most a row per slot
    slot, n = counts["slot"].to_numpy(), counts["n"].to_numpy()
    mean = n[slot < 0].sum() / slots
    bits = np.zeros(slots, np.uint8)
    bits[slot[(slot >= 0) & (n > max(64, 2 * mean))]] = 1
    common = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    pieces = rows.where("doc_id IS NOT NULL").select("doc_id", "tag", "text").mapInArrow(anchored(common), "doc_id long, tag long, at int, n int, anchor long, piece long")
    pieces = written(pieces, "window-anchors")
    several = pieces.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high").select("anchor", "rows")
    several = written(several, "anchors-of-several")
    # An anchor with over a thousandth of all pieces is one of under a thousand: those stay where they are, by broadcast.
    often = several.where(F.col("rows") > max(block, pieces.count() // 1000)).select("anchor")
    hot = pieces.join(F.broadcast(often), "anchor", "left_semi")
    cold = pieces.join(F.broadcast(often), "anchor", "left_anti").join(several.select("anchor"), "anchor", "left_semi")
    every, pieces = pieces, written(hot.unionByName(cold), "shared-anchors")
    spent(every, several)
    distinct = written(pieces.groupBy("anchor", "piece").agg(F.min(F.struct("doc_id", "tag", "at", "n")).alias("x")).select("anchor", "piece", "x.*"), "distinct-pieces")
    # Pieces of an anchor that has over ``block`` of them are cut into windows, which their own hashes deal to parts.
    large = distinct.groupBy("anchor").agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > block)
    large = written(large.select("anchor", (F.ceil(F.col("windows") / block).cast("int") + 1).alias("parts")), "large-anchors")
    want = distinct.join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    want = want.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "piece", "at", "n", "parts")).alias("want"))
    reference = rows.join(want, ["doc_id", "tag"]).select("doc_id", "text", "want").mapInArrow(cut, "anchor long, part int, first_doc long, piece long, off int, words binary")
    found = reference.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "first_doc").mapInArrow(shards, "anchor long, piece long, off int, len int, owner long")
    found = written(found, "first-occurrences")
    spent(distinct, large)

    covered = pieces.join(found, ["anchor", "piece"]).where("owner < doc_id")
    covered = covered.select("doc_id", "tag", (F.col("at") + F.col("off")).alias("at"), F.col("len").alias("n"))
    covered = covered.groupBy(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list(F.struct("at", "n")).alias("__covered"))
    none = F.array().cast("array<struct<at:int,n:int>>")
    own = docs.withColumn("__text", F.col(text).cast("string"))
    found = own.join(covered, (F.col(doc_id).cast("long") == F.col("__doc")) & (F.xxhash64("__text") == F.col("__tag")), "left")
    found = found.select(*([F.col(doc_id).cast("long").alias("doc_id")] if not carry else docs.columns), F.col("__text").alias("__text"), F.coalesce("__covered", none).alias("__covered"))
    made = "__text string, __n_words long, __n_removed long, __spans array<struct<at:long,words:long>>"
    out = found.mapInArrow(strip, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:-2]] + [made]))
    if carry:
        return out
    return out.select("doc_id", F.col("__text").alias("text"), F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__spans").alias("spans"))


@sheltered
def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated words gone: a text that loses words is its kept words joined by one space, others stay as they are.

    A row that loses all its words goes; a column ``n_chars`` follows the text. All other columns stay.
    """
    out = remove_repeated(docs, carry=True, **options).where("__n_removed = 0 OR __n_removed < __n_words")
    lost = F.col("__n_removed") > 0
    changed = {"text": F.when(lost, F.col("__text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def op10_repeated_spans(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows of all documents: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
p AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
g AS (
  SELECT p.doc_id, p.i, md5(array_to_string(d.w[p.i : p.i + 49], ' ')) AS h FROM p JOIN d USING (doc_id)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (
  SELECT DISTINCT g.doc_id, unnest(generate_series(g.i, g.i + 49)) AS i FROM g JOIN f USING (h) WHERE f.first < g.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(r.gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN r.gone IS NULL THEN d.w ELSE list_transform(list_filter(generate_series(1, len(d.w)), lambda i: NOT list_contains(r.gone, i)), lambda i: d.w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
