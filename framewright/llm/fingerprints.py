"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's units are its paragraphs (lines); longer ones are cut after content-chosen words, so that an edit changes the
unit it falls in and no other. Each unit's digest is added to three cells of a table that is large enough to give all its
digests back: a table that doesn't peel to nothing by itself is made again, larger. Tables of two texts
subtract cell by cell; peeling cells that hold one digest recovers the digests of either side alone, and so how many the
texts share. Where the difference doesn't peel, both are listed and put into larger tables. Two fingerprints are thus all
that a comparison needs, whatever the texts.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents, mix, span_hashes

HASHES = 3  # cells that hold a digest
CELL = np.dtype([("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])


def units(texts: pa.Array, longest: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(digests, edges): the distinct unit digests of each text, sorted. ``longest``: mean words of a cut unit."""
    words = Words(texts)
    line = np.cumsum(words.data == 10)[words.starts] if len(words.starts) else words.starts
    row = np.repeat(np.arange(len(texts)), np.diff(words.edges))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | (words.hashes[:-1] % np.uint64(longest) == 0)
    starts = np.flatnonzero(new)
    digests = span_hashes(words.hashes, starts, np.append(starts[1:], len(row)))
    owner = row[starts]
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    once = np.ones(len(digests), bool)
    once[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
    return digests[once], np.searchsorted(owner[once], np.arange(len(texts) + 1))


def larger(size: np.ndarray) -> np.ndarray:
    """The next of the sizes 4, 6, 8, 12, 16, 24 ...: few of them, so that most versions of a text have equal ones."""
    power = 1 << np.floor(np.log2(size)).astype(np.int64)
    return np.where(size == power, power + power // 2, 2 * power)


def enough(number: np.ndarray) -> np.ndarray:
    """The first of those sizes with half as many cells again as digests, over all hash functions."""
    size = np.full(len(number), 4, np.int64)
    while (small := 2 * HASHES * size < 3 * number).any():
        size[small] = larger(size[small])
    return size


class Tables:
    """Lookup tables, each of its own ``size``: per cell a count, the sum of digests, the sum of their check values."""

    def __init__(self, size: np.ndarray, count=None, keys=None, checks=None):
        self.size, self.edges = size, np.concatenate([[0], np.cumsum(HASHES * size)])
        cells = int(self.edges[-1])
        self.count = np.zeros(cells, np.int32) if count is None else count
        self.keys = np.zeros(cells, np.uint64) if keys is None else keys
        self.checks = np.zeros(cells, np.uint32) if checks is None else checks

    def places(self, digests, owner) -> np.ndarray:
        """[hash function, digest]: the cells of each."""
        size, out = self.size[owner], np.empty((HASHES, len(digests)), np.int64)
        wide = size.astype(np.uint64)
        salted = digests + wide * np.uint64(2654435761)
        for j in range(HASHES):
            out[j] = self.edges[owner] + j * size + (mix(salted + np.uint64(j + 1)) % wide).astype(np.int64)
        return out

    @staticmethod
    def check(digests):
        return (mix(digests ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)

    def add(self, digests, owner, signs) -> np.ndarray:
        """Adds (sign 1) or takes away (-1) digests; returns their cells."""
        signs = np.full(len(digests), signs, np.int32) if np.isscalar(signs) else signs
        keys, checks = digests * signs.astype(np.uint64), self.check(digests) * signs.astype(np.uint32)
        places = self.places(digests, owner)
        for at in places:
            np.add.at(self.count, at, signs)
            np.add.at(self.keys, at, keys)
            np.add.at(self.checks, at, checks)
        return places.ravel()

    def copy(self) -> "Tables":
        return Tables(self.size, self.count.copy(), self.keys.copy(), self.checks.copy())

    def minus(self, other: "Tables") -> "Tables":
        return Tables(self.size, self.count - other.count, self.keys - other.keys, self.checks - other.checks)

    def peel(self):
        """(digests, owners, signs: +1 left or -1 right side alone) and whether each table came out empty; empties the tables."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            sign = self.count[at]
            digest = self.keys[at] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (self.checks[at] * sign.astype(np.uint32) == self.check(digest))
            digest, sign, owner = digest[pure], sign[pure], np.searchsorted(self.edges, at[pure], "right") - 1
            order = np.lexsort((digest, owner))
            digest, sign, owner = digest[order], sign[order], owner[order]
            once = np.ones(len(digest), bool)
            once[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
            digest, sign, owner = digest[once], sign[once], owner[once]
            found.append((digest, owner, sign))
            at = self.add(digest, owner, -sign)  # only cells that changed can be new
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        bad = np.zeros(len(self.size), bool)
        bad[np.searchsorted(self.edges, np.flatnonzero(left), "right") - 1] = True
        return *(np.concatenate(x) for x in zip(*found)), ~bad


class Fingerprints:
    """Stored tables of many texts: ``number`` of digests and ``size`` of each, ``cells`` of all one after the other."""

    def __init__(self, number, size, cells):
        self.number, self.size, self.cells = number, size, cells
        self.edges = np.concatenate([[0], np.cumsum(HASHES * size)])

    @classmethod
    def of(cls, digests: np.ndarray, edges: np.ndarray) -> "Fingerprints":
        """Tables of the digest sets digests[edges[i] : edges[i + 1]], of the first size from :func:`enough` up that peels by itself."""
        number = np.diff(edges)
        size = enough(number)
        while True:
            made = Tables(size)
            made.add(digests, np.repeat(np.arange(len(number)), number), 1)
            whole = made.copy().peel()[3]
            if whole.all():
                break
            size = np.where(whole, size, larger(size))
        cells = np.empty(len(made.count), CELL)
        cells["count"], cells["keys"], cells["checks"] = made.count, made.keys, made.checks
        return cls(number, size, cells)

    @classmethod
    def read(cls, strings: list) -> "Fingerprints":
        number, raw = zip(*[(int(n), base64.b64decode(x)) for n, _, x in (s.partition(".") for s in strings)]) if strings else ((), ())
        size = np.array([len(x) // (HASHES * CELL.itemsize) for x in raw], np.int64)
        return cls(np.array(number, np.int64), size, np.frombuffer(b"".join(raw), CELL))

    def strings(self) -> list:
        """Each table as text: the number of digests, then its cells in base 64."""
        raw, edges = self.cells.tobytes(), (self.edges * CELL.itemsize).tolist()
        return [f"{n}.{base64.b64encode(raw[a:b]).decode()}" for n, a, b in zip(self.number.tolist(), edges, edges[1:])]

    def take(self, rows: np.ndarray) -> "Fingerprints":
        return Fingerprints(self.number[rows], self.size[rows], _take(self.cells, self.edges, rows)[0])

    def stored(self) -> Tables:
        return Tables(self.size, *(np.ascontiguousarray(self.cells[c]) for c in CELL.names))

    def tables(self, size: np.ndarray) -> Tables:
        """The tables at ``size``: as stored, or of other size listed and added anew."""
        other = np.flatnonzero(self.size != size)
        if not len(other):
            return self.stored()
        out, own = Tables(size), np.flatnonzero(self.size == size)
        at = _take(np.arange(len(out.count)), out.edges, own)[0]
        cells = _take(self.cells, self.edges, own)[0]
        out.count[at], out.keys[at], out.checks[at] = cells["count"], cells["keys"], cells["checks"]
        digests, owner, _, whole = self.take(other).stored().peel()
        if not whole.all():
            raise ValueError("a fingerprint is damaged")
        out.add(digests, other[owner], 1)
        return out


def _take(values, edges, rows):
    """(values of the rows edges[i] .. edges[i + 1] one after the other, which of ``rows`` each belongs to)."""
    n = np.diff(edges)[rows]
    at = np.repeat(edges[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return values[at], np.repeat(np.arange(len(rows)), n)


def differences(left: Fingerprints, right: Fingerprints) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of digests that only the left and only the right text has, pair by pair, from the stored tables alone.

    A pair begins at the larger of its tables' sizes; on failure it is tried again where both sides have room, then at
    the next sizes: the hash functions depend on the size, so each draws again and fails only by chance.
    """
    size = np.maximum(left.size, right.size)
    only = np.zeros((2, len(size)), np.int64)
    open_ = np.arange(len(size))
    while len(open_):
        a, b = left.take(open_), right.take(open_)
        _, owner, sign, done = a.tables(size).minus(b.tables(size)).peel()
        for side, which in enumerate((1, -1)):
            only[side] += np.bincount(open_[owner[(sign == which) & done[owner]]], minlength=len(left.size))
        open_, size = open_[~done], np.maximum(larger(size), enough(a.number + b.number))[~done]
    return only[0], only[1]


def likeness(left: Fingerprints, right: Fingerprints) -> np.ndarray:
    """Shared digests in relation to the two sets' mean size; 1 for two texts without any."""
    alone, _ = differences(left, right)
    a, b = left.number, right.number
    return np.where(a + b > 0, 2 * (a - alone) / np.maximum(a + b, 1), 1.0)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", longest: int = 8, batch_bytes: int = 4 << 20, range_rows: int = 16_384) -> DataFrame:
    """Every text beside an edited version of it and the next document's text (descending doc_id, after the last the first).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. Null texts are empty; texts without words have an empty fingerprint, alike to each other (1.0). Null ids
    come last; null and repeated ids stand in the order of their texts' hashes. A single row is its own next. Other columns are ignored; an empty
    table gives no rows. ``near_edited`` and ``near_next`` come from the fingerprints alone: :func:`likeness` of the strings gives them again.
    Texts are shuffled once: ids are cut into ordered ranges (64 quantiles of all ids, each cut evenly for about ``range_rows`` rows, at
    most 2,048 times; null ids into 1,024 by hash), and each range also gets the first row of the next one; a range streams through its task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    q, total = rows.agg(F.percentile_approx("doc_id", [k / 64 for k in range(65)], 10_000), F.count(F.lit(1))).head()
    marks = sorted(set(q or [0]))
    finer = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8, min(2048, total // (64 * range_rows)))
    coarse = sum((F.col("doc_id") > F.lit(s)).cast("int") for s in marks)  # 0 .. len(marks)
    low = F.element_at(F.array(*map(F.lit, [marks[0], *marks])), coarse + 1)
    high = F.element_at(F.array(*map(F.lit, [*marks, marks[-1]])), coarse + 1)
    inside = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * F.lit(finer))
    place = coarse * F.lit(finer) + F.greatest(F.lit(0), F.least(inside, F.lit(finer - 1)))
    nulls = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 54) + 1
    rows = rows.withColumn("bucket", F.coalesce(-place, nulls).cast("long"))

    # The first row of each range: as many rows as there are ranges.
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    ahead = spark.createDataFrame([(r.bucket, r.doc_id, heads[k - 1].bucket) for k, r in enumerate(heads)], "own long, head_id long, before long")
    tied = rows.join(F.broadcast(ahead), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    ahead = tied.groupBy("own", "head_id", "before").agg(F.min("h").alias("head_h"))
    head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    marked = rows.join(F.broadcast(ahead), F.col("bucket") == F.col("own"))
    copies = F.when(head, F.array(F.struct("bucket", F.lit(0).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("extra"))))
    dealt = marked.select("doc_id", "text", "h", F.explode(copies).alias("x")).select("x.bucket", "x.extra", "doc_id", "text", "h")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "h")

    def judge(rows):
        """rows: (doc_id, text, next text)"""
        texts = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in rows]
        n = len(rows)
        apart = [k for k in range(n) if k + 1 == n or rows[k][2] is not texts[k + 1]]  # whose next text isn't the next row's
        after = np.arange(1, n + 1)
        after[apart] = n + np.arange(len(apart))
        own = Fingerprints.of(*units(pa.array([*texts, *(rows[k][2] for k in apart)], pa.large_string()), longest))
        changed = Fingerprints.of(*units(pa.array(edited, pa.large_string()), longest))
        own, following = own.take(np.arange(n)), own.take(after)
        columns = [[r[0] for r in rows], [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], own.strings(), changed.strings(), likeness(own, changed), likeness(own, following)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[x.split()[0] for x in OUT.split(", ")])

    def run(iterator):
        last, held, size = None, [], 0  # last: the row that waits for the next one's text
        for batch in iterator:
            for bucket, extra, d, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last is not None and last[0] == bucket and not last[1]:
                    held.append((last[2], last[3], t))
                    size += len(last[3]) + len(t)
                    if size > batch_bytes:
                        yield judge(held)
                        held, size = [], 0
                last = (bucket, extra, d, t)
        if held:
            yield judge(held)

    return dealt.select("bucket", "extra", "doc_id", "text").mapInArrow(run, OUT)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(documents(spark, sf_dir))
