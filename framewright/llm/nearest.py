"""Exact top-k inner products as a Voronoi join.

Pivots part queries and data into cells. Against a cell's pivot each vector has a part along it (``a``) and a rest of length
``b``, so an inner product lies between a * a' - b * b' and a * a' + b * b'. From a summary of each cell's queries
(the range of ``a``, the largest ``b``) every row of data has a lower bound with each cell; the k + 1 best of them (one may be
the query's own row) say what each of its queries reaches at least. Rows whose upper bound is below that are needless for the
cell. Cells whose pivots are close are put together to groups of bounded size; a row goes once to each group that needs it, and there
it meets the queries of the cells that need it. A group with many rows is dealt into blocks, whose best are merged. Bounds only
spare work: where vectors lie alike in all directions they spare little, and the join is the plain blocked product.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, partition_id, written

_HELD = 1 << 22  # inner products held at once


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Matrix of packed vectors: 4 or 8 bytes a component."""
    blobs = column.to_pylist()
    out = np.zeros((len(blobs), size), np.int64)
    for width, kind in ((4, np.int32), (8, np.int64)):
        own = [k for k, b in enumerate(blobs) if len(b) == width * size]
        if own and size:
            out[own] = np.frombuffer(b"".join(blobs[k] for k in own), kind).reshape(-1, size)
    return out


def _parts(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part along each pivot, length of the rest) of each row."""
    matrix = matrix.astype(np.float64)
    along = matrix @ pivots.T
    return along, np.sqrt(np.maximum((matrix**2).sum(axis=1)[:, None] - along**2, 0))


class Cells:
    """The cells that hold queries: pivots, ranges of their queries and, once known, what these reach at least."""

    def __init__(self, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray):
        self.pivots, self.low, self.high, self.rest = pivots, low, high, rest
        self.reached = np.full(len(low), -np.inf)

    def bounds(self, matrix: np.ndarray, which=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) inner product of each row with any query of each cell, rounding errors allowed for."""
        along, rest = _parts(matrix, self.pivots[which])
        low, high, most = along * self.low[which], along * self.high[which], rest * self.rest[which]
        slack = 1 + 1e-9 * (np.abs(low) + np.abs(high) + most)
        return np.minimum(low, high) - most - slack, np.maximum(low, high) + most + slack

    def needed(self, matrix: np.ndarray, which=slice(None)) -> np.ndarray:
        return self.bounds(matrix, which)[1] >= self.reached[which]


def grouped(pivots: np.ndarray, counts: np.ndarray, cap: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Groups of (cell, part, parts): neighbours in a chain of close pivots, up to ``cap`` queries; a larger cell is in parts."""
    cap = max(1, min(cap, ceil(counts.sum() / least)))
    left, chain = list(range(len(counts))), [0]
    left.remove(0)
    while left:
        chain.append(left.pop(int(np.argmax(pivots[left] @ pivots[chain[-1]]))))
    groups, held = [[]], 0
    for cell in chain:
        parts = ceil(counts[cell] / cap)
        for part in range(parts):
            size = ceil(counts[cell] / parts)
            if held and held + size > cap:
                groups.append([])
                held = 0
            groups[-1].append((cell, part, parts))
            held += size
    return groups


def best_of(queries: np.ndarray, own: np.ndarray, data: np.ndarray, rows: np.ndarray, k: int, bound: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, place in data, score) of each query's ``k`` highest, ties to the first place; a query's own row is left out.

    ``own`` and ``rows`` are row numbers. Products are exact: in float64 while ``bound`` on them is below 2^53, else in int64.
    """
    if not len(data) or not len(queries):
        return []
    kind = np.float64 if bound < 2**53 else np.int64
    a, out = queries.astype(kind).T, []
    sorted_rows = np.argsort(rows)
    step = max(k + 1, _HELD // len(queries))
    for s in range(0, len(data), step):
        scores = (data[s : s + step].astype(kind) @ a).astype(np.int64)
        n = len(scores)
        mine = sorted_rows[np.minimum(np.searchsorted(rows, own, sorter=sorted_rows), len(rows) - 1)]
        hit = (rows[mine] == own) & (mine >= s) & (mine < s + n)
        if bound * n < 2**62:
            key = scores * n + np.arange(n - 1, -1, -1)[:, None]
            key[mine[hit] - s, np.flatnonzero(hit)] = -(2**62)
            first = np.argpartition(-key, min(k, n - 1), axis=0)[:k] if n > k else np.broadcast_to(np.arange(n)[:, None], key.shape)
        else:  # a stable order keeps the first of equals first; the own row goes to one more place
            first = np.argsort(-scores, axis=0, kind="stable")[: k + 1]
        query = np.broadcast_to(np.arange(len(own)), first.shape)
        ok = rows[first + s] != own[query]
        out.append((query[ok], first[ok] + s, np.take_along_axis(scores, first, 0)[ok]))
    return out


def voronoi_top_k(vectors: DataFrame, *, k: int = 5, pivots: int = 256, group: int = 8192, groups: int = 4, block: int = 32768) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows with the highest inner product with each query.

    ``vectors``: vec_id long, query boolean, vector array<long>; all rows are candidates, those marked ``query`` are queries, too, and
    have every row but themselves as candidates (all of them, if fewer than ``k``). Ties go to the smaller vec_id, null last.
    Pivots are ``pivots`` rows chosen by hash; any choice gives the same result. Rows with a null vector or component take no
    part. Shorter vectors count as filled with zeros, so an empty one scores 0 with all. Rows that repeat an id are rows of their own: each
    is a query with ranks of its own, and a candidate of the other. No rows or queries give an empty result. Inner products that
    could pass 62 bits are an error. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())).select("vec_id", F.coalesce("query", F.lit(False)).alias("query"), "vector")
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 1  # vectors of zeros, if all are empty
    picked = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector"), "vector").limit(4 * pivots).toArrow()["vector"].to_pylist()
    picked = np.unique(np.array([v + [0] * (size - len(v)) for v in picked], np.float64).reshape(len(picked), size), axis=0)
    length = np.sqrt((picked**2).sum(axis=1))
    directions = np.unique((picked[length > 0] / length[length > 0][:, None]), axis=0)[:: max(1, -(-len(picked) // pivots))]
    directions = directions if len(directions) else np.zeros((1, size))

    def prepare(iterator):
        number = partition_id() << 32
        for batch in iterator:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            ends, flat = np.cumsum(np.asarray(column.value_lengths())), column.flatten().to_numpy()
            counts = np.diff(ends, prepend=0)
            matrix = np.zeros((batch.num_rows, size), np.int64)
            row = np.repeat(np.arange(batch.num_rows), counts)
            matrix[row, np.arange(len(flat)) - np.repeat(ends - counts, counts)] = flat
            along, rest = _parts(matrix, directions)
            cell = along.argmax(axis=1)
            at = (np.arange(batch.num_rows), cell)
            small = (np.abs(matrix.astype(np.float64)) < 2**31).all(axis=1)
            packed = [v.astype(np.int32 if s else np.int64).tobytes() for v, s in zip(matrix, small)]
            columns = [pa.array(number + np.arange(batch.num_rows)), batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(cell), pa.array(along[at]), pa.array(rest[at])]
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "query", "v", "cell", "a", "b"])

    table = written(rows.select("vec_id", "query", F.col("vector").cast("array<long>").alias("vector")).mapInArrow(prepare, "row long, vec_id long, query boolean, v binary, cell long, a double, b double"), "cells")
    summary = table.where("query").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("low"), F.max("a").alias("high"), F.max("b").alias("rest")).orderBy("cell").toPandas()  # a row a pivot at most
    if not len(summary):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    most, most_query = table.agg(F.max(norm), F.max(F.when(F.col("query"), norm))).first()
    bound = 1.001 * most * most_query + 1
    if bound >= 2**62:
        raise ValueError("inner products could pass 62 bits")
    cells = Cells(directions[summary["cell"]], *(summary[c].to_numpy() for c in ("low", "high", "rest")))
    count = len(summary)

    def lower(iterator):
        kept = np.full((0, count), -np.inf)
        for batch in iterator:
            matrix = _vectors(batch.column(0), size)
            for s in range(0, len(matrix), 4096):
                kept = np.concatenate([kept, cells.bounds(matrix[s : s + 4096])[0]])
                kept = -np.partition(-kept, k, axis=0)[: k + 1] if len(kept) > k + 1 else kept
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count), len(kept))), pa.array(kept.ravel())], names=["at", "low"])

    lows = table.select("v").mapInArrow(lower, "at long, low double").withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("low"))))
    for at, low in lows.where(F.col("r") == k + 1).select("at", "low").collect():  # a row a pivot at most
        cells.reached[at] = low
    dealt = grouped(cells.pivots, summary["n"].to_numpy(), group, groups)
    member = np.zeros((count, len(dealt)), bool)
    parts = np.ones(count, np.int64)
    place = {}
    for g, own in enumerate(dealt):
        for cell, part, of in own:
            member[cell, g], parts[cell], place[cell, part] = True, of, g
    of_pivot = {int(c): i for i, c in enumerate(summary["cell"])}

    def wanted(matrix):
        """Which groups need each row."""
        return (cells.needed(matrix).astype(np.float32) @ member.astype(np.float32)) > 0

    def tally(iterator):
        total = np.zeros(len(dealt), np.int64)
        for batch in iterator:
            matrix = _vectors(batch.column(0), size)
            for s in range(0, len(matrix), 4096):
                total += wanted(matrix[s : s + 4096]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(dealt))), pa.array(total)], names=["grp", "n"])

    needs = dict(table.select("v").mapInArrow(tally, "grp long, n long").groupBy("grp").agg(F.sum("n")).collect())  # a row for ``group`` queries
    blocks = np.array([max(1, ceil(needs.get(g, 0) / block)) for g in range(len(dealt))])

    def ship(iterator):
        for batch in iterator:
            row, hot = batch.column(0).to_numpy(), np.asarray(batch.column(2))
            spread = mix(row.astype(np.uint64))
            matrix = _vectors(batch.column(3), size)
            at, grp = (np.concatenate(c) for c in zip(*((np.array(x) + [[s], [0]] for s in range(0, len(matrix), 4096) for x in [np.nonzero(wanted(matrix[s : s + 4096]))]))))
            yield dealt_out(batch, at, grp, (spread[at] % blocks[grp].astype(np.uint64)).astype(np.int64), False, at * 0)
            own = np.flatnonzero(hot)
            cell = np.array([of_pivot[c] for c in batch.column(4).to_numpy()[own].tolist()], np.int64)
            part = ((spread[own] >> np.uint64(32)) % parts[cell].astype(np.uint64)).astype(np.int64)
            grp = np.array([place[x] for x in zip(cell.tolist(), part.tolist())], np.int64)
            each = blocks[grp]
            which = np.repeat(np.arange(len(own)), each)
            number = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            yield dealt_out(batch, own[which], grp[which], number, True, cell[which])

    def dealt_out(batch, at, grp, number, query, cell):
        at = pa.array(at, pa.int64())
        columns = [pa.array(grp, pa.int64()), pa.array(number, pa.int64()), pa.array(np.full(len(at), query)), pa.array(cell, pa.int64()), *(batch.column(c).take(at) for c in (0, 1, 3))]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "block", "query", "cell", "row", "vec_id", "v"])

    def solve(key, held):
        held = held.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids come last
        asks = held.filter(held["query"])
        data = held.filter(pa.compute.invert(held["query"]))
        found = []
        if asks.num_rows and data.num_rows:
            matrix, rows = _vectors(data["v"].combine_chunks(), size), data["row"].to_numpy()
            queries, own, cell = _vectors(asks["v"].combine_chunks(), size), asks["row"].to_numpy(), asks["cell"].to_numpy()
            which = np.unique(cell)
            needed = np.concatenate([cells.needed(matrix[s : s + 4096], which) for s in range(0, len(matrix), 4096)])
            share = needed.mean(axis=0)
            lots = [(np.isin(cell, which[share > 0.5]), slice(None))] + [(cell == which[c], np.flatnonzero(needed[:, c])) for c in np.flatnonzero(share <= 0.5).tolist()]
            for mine, some in lots:
                mine = np.flatnonzero(mine)
                places = np.arange(len(rows))[some]
                found += [(mine[q], places[p], s) for q, p, s in best_of(queries[mine], own[mine], matrix[some], rows[some], k, bound)]
        q, p, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        q, p = pa.array(q), pa.array(p)
        columns = [asks["row"].take(q), asks["vec_id"].take(q), data["vec_id"].take(p), pa.array(s), data["row"].take(p)]
        return pa.table(columns, names=["asked", "query_id", "vec_id", "score", "row"])

    shipped = table.select("row", "vec_id", "query", "v", "cell").mapInArrow(ship, "grp long, block long, query boolean, cell long, row long, vec_id long, v binary")
    best = shipped.groupBy("grp", "block").applyInArrow(solve, "asked long, query_id long, vec_id long, score long, row long")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of each fiftieth embedding by inner product of whole numbers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite).select("vec_id", (F.col("vec_id") % 50 == 0).alias("query"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"))
    return voronoi_top_k(rows)


OP13_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, d.row, d.vec_id,
    list_sum(list_transform(list_zip(q.v, d.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.row <> d.row)
SELECT query_id, row_number() OVER (PARTITION BY asked ORDER BY coalesce(score, 0) DESC, vec_id NULLS LAST, row)::INTEGER AS rank, vec_id, coalesce(score, 0) AS score
FROM s QUALIFY rank <= 5
"""
