"""Periodic runs of words, found on an enhanced suffix array by the branching-tandem test.

The texts of a batch share one suffix array that never crosses a text: ranks of prefixes of 1, 2, 4, ... words are refined until all
suffixes differ, and each level's ranks are kept, which makes every longest common extension a few comparisons.
A boundary of the array with common prefix ``d`` parts its LCP interval in two; for each suffix of the smaller part the
one ``d`` words on and the one ``d`` words back are looked up in the inverse array. One that lies in the other part makes a
square whose next word differs (a branching tandem). Rotating squares to the left gives their runs; those
that coincide merge under the smallest period. Intervals are places in arrays, there are no tree nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import batches, blobs, documents

LOT = 1 << 21  # suffixes that are looked up at once


def prefix_ranks(words: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words of each suffix; the last has all different. A rank is the place of the first of its equals.

    ``edges``: text i holds words edges[i] to edges[i + 1]. Suffixes of different texts always differ. One more entry
    stands at the end of each level, different from all.
    """
    n = len(words)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    stop = edges[1:][text]
    rank = np.full(n + 1, n, np.int32)
    order, key = np.arange(n), text * (int(words.max(initial=0)) + 1) + words
    levels, group, length = [], np.zeros(n, np.int64), 1
    while True:
        at = np.argsort(key, kind="stable")
        order, key, group = order[at], key[at], group[at]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        lead = np.ones(len(key), bool)  # where a group of the level before begins
        lead[1:] = group[1:] != group[:-1]
        lead = np.flatnonzero(lead)
        begin = np.repeat(lead, np.diff(np.append(lead, len(key))))
        place = np.repeat(first, np.diff(np.append(first, len(key)))) - begin + group
        rank = rank.copy()
        rank[order] = place
        levels.append(rank)
        again = np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))
        order, group = order[again], place[again]
        if not len(order):
            return levels
        after = order + length
        key = group * (n + 2) + np.where(after < stop[order], rank[np.minimum(after, n)].astype(np.int64) + 1, 0)
        length *= 2


def common_prefixes(levels: list[np.ndarray], array: np.ndarray) -> np.ndarray:
    """Words that neighbours of the suffix array share, at the later one's place; 0 at the first."""
    out = np.zeros(len(array), np.int32)
    left = np.arange(1, len(array))
    for k, rank in enumerate(levels):
        same = rank[array[left - 1]] == rank[array[left]]
        done = left[~same]
        if k:
            a, b, shared = array[done - 1], array[done], np.full(len(done), 1 << (k - 1), np.int32)
            for j in range(k - 2, -1, -1):
                shared += (levels[j][a + shared] == levels[j][b + shared]) * np.int32(1 << j)
            out[done] = shared
        left = left[same]
    return out


def intervals(lcp: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary in ``at`` the first place of the part before it and the place after the part behind it.

    The part behind ends before the next boundary that is no higher, so each pair of suffixes is parted by one boundary.
    """
    lows = [lcp]
    while 1 << len(lows) <= longest:
        step = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][: len(lows[-1]) - step], lows[-1][step:]) if len(lows[-1]) > step else lows[-1][:0])
    depth, lo, hi = lcp[at], at.copy(), at + 1
    for k in range(len(lows) - 1, -1, -1):
        low, step = lows[k], 1 << k
        if not len(low):
            continue
        go = lo >= step
        go &= low[np.where(go, lo - step, 0)] >= depth
        lo -= go * step
        go = hi < len(low)
        go &= low[np.where(go, hi, 0)] > depth
        hi += go * step
    return lo - 1, hi


def branching_squares(array: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each square whose second half is followed by another word than the first."""
    n = len(array)
    inverse = np.append(inverse[:n], -1)
    at = np.flatnonzero(lcp > 0)
    lo, hi = intervals(lcp, at, longest)
    smaller_left = at - lo <= hi - at
    begin, size = np.where(smaller_left, lo, at), np.where(smaller_left, at - lo, hi - at)
    other, other_stop = np.where(smaller_left, at, lo), np.where(smaller_left, hi, at)
    total = np.cumsum(size)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LOT, side="right")))
        for c in range(0, int(size[a]) if b == a + 1 else 1, LOT):  # one large part in several lots
            some = np.minimum(size[a:b] - c, LOT) if b == a + 1 else size[a:b]
            which = np.repeat(np.arange(a, b), some)
            place = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some) + c + begin[which]
            i, d = array[place].astype(np.int64), lcp[at[which]].astype(np.int64)
            for start, mate in ((i, np.minimum(i + d, n)), (i - d, np.where(i >= d, i - d, n))):
                rank = inverse[mate]
                hit = (rank >= other[which]) & (rank < other_stop[which])
                starts.append(start[hit])
                periods.append(d[hit])
        a = b
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of every run of at least two periods, by start and period; places in ``words``."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    levels = prefix_ranks(words, edges)
    inverse = levels[-1]
    array = np.empty(len(words), np.int32)
    array[inverse[:-1]] = np.arange(len(words), dtype=np.int32)
    lcp = common_prefixes(levels, array)
    start, period = branching_squares(array, inverse, lcp, int(np.diff(edges).max()))
    stop = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left as far as it goes
        back = start - (1 << k)
        go = back >= 0
        go &= levels[k][np.where(go, back, 0)] == levels[k][np.where(go, back + period, len(words))]
        start = start - go * (1 << k)
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[first], stop[first], period[first]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def periodic_runs(docs: DataFrame, *, least: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, from 0. A run is a stretch with smallest period ``q`` (words q apart are identical) of at
    least max(``least``, 2 * q) words that no neighbouring word extends. ``collapsed`` is the text without the words that some
    run contains after its first q, joined by one space.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Null, equal and repeated ids keep a row
    each. A very long text is worked on whole, by itself. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """

    def find(iterator):
        for batch in batches(iterator, "text"):
            number, words, edges = _Numbers(), [], [0]
            for blob in blobs(batch, "text"):
                words += blob.split() if blob else ()  # bytes split at the ASCII white space that parts words
                edges.append(len(words))
            codes, edges = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.array(edges)
            start, stop, period = runs_of(codes, edges)
            long = stop - start >= least
            start, stop, period = start[long], stop[long], period[long]
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, stop, -1)
            kept = np.cumsum(drop)[:-1] == 0
            touched = np.add.reduceat(np.append(~kept, False), edges[:-1]) * (np.diff(edges) > 0) if len(edges) > 1 else ()
            collapsed = [b" ".join([w for w, k in zip(words[a:b], kept[a:b].tolist()) if k] if cut else words[a:b]) for a, b, cut in zip(edges[:-1].tolist(), edges[1:].tolist(), touched)]
            own = np.searchsorted(start, edges)
            values = pa.StructArray.from_arrays([pa.array(start - edges[:-1][np.repeat(np.arange(len(own) - 1), np.diff(own))]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(own, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _with_periods(docs: DataFrame) -> DataFrame:
    """The query's texts: those of a tenth of the documents, chosen by the checksum of their id, become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def periodic(s):
        n = F.size(s["w"]).cast("long")
        a = s["g"] % n
        return let(F.struct(s["w"].alias("w"), a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + s["g"] % 8))).alias("p")), repeat)

    def repeat(s):
        place = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["w"]) - 1), lambda i: F.get(s["w"], place(i))), " ")

    changed = let(F.struct(words.alias("w"), g.alias("g")), lambda s: F.when(F.size(s["w"]) > 0, periodic(s)).otherwise(""))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents' words, a tenth of them made periodic; digests of the runs and of what is left without them."""
    found = periodic_runs(_with_periods(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM h),
e AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(generate_series(0, n - 1), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM e),
t AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM d),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM p),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM t
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
c AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(c.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
