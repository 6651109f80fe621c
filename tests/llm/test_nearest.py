"""Exact top-k inner products against brute force."""

import random

import numpy as np
import pytest
from framewright.llm import nearest as ne


def brute(rows, k):
    """rows: (vec_id, query, vector); vectors that are None or hold None take no part."""
    rows = [r for r in rows if r[2] is not None and None not in r[2]]
    size = max((len(r[2]) for r in rows), default=0)
    m = np.array([list(r[2]) + [0] * (size - len(r[2])) for r in rows], dtype=object).reshape(len(rows), size)
    out = []
    for i, (q, ask, _) in enumerate(rows):
        if ask:
            scores = [(-int((m[i] * m[j]).sum()), r[0] is None, r[0] or 0) for j, r in enumerate(rows) if j != i]
            out += [(q, n + 1, None if null else v, -s) for n, (s, null, v) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def clustered(count, size, seed, spread=6, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-100, 100, (centres, size))
    near = middle[rng.integers(0, centres, count)] + rng.integers(-spread, spread + 1, (count, size))
    return [(i, i % 5 == 0, v) for i, v in enumerate(near.tolist())]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, query boolean, vector array<long>").repartition(3)
    return sorted(map(tuple, ne.voronoi_top_k(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"k": 3, "pivots": 4, "group": 7, "block": 50}, {"k": 1, "pivots": 1}, {"k": 400, "pivots": 30, "group": 20}])
def test_clustered(spark, options):
    rows = clustered(300, 8, 1)
    assert run(spark, rows, **options) == brute(rows, options.get("k", 5))


def test_bounds_spare_work_and_lose_nothing():
    """On clusters most rows are needless for most cells; no needed row is among them."""
    rows = clustered(2000, 16, 3, spread=3)
    m, k = np.array([r[2] for r in rows]), 5
    pivots = m[::100] / np.sqrt((m[::100].astype(float) ** 2).sum(axis=1))[:, None]
    along, rest = ne._parts(m, pivots)
    cell = along.argmax(axis=1)
    asks = np.arange(0, 2000, 5)
    held = np.unique(cell[asks])
    own = [asks[cell[asks] == c] for c in held]
    cells = ne.Cells(pivots[held], *(np.array([f(x[i, c] for i in o) for o, c in zip(own, held)]) for f, x in ((min, along), (max, along), (max, rest))))
    cells.reached = np.sort(cells.bounds(m)[0], axis=0)[-k - 1]
    needed, scores = cells.needed(m), m @ m.T
    assert needed.mean() < 0.5
    for c, o in enumerate(own):
        for q in o.tolist():
            best = np.sort(np.delete(scores[q], q))[-k]
            assert needed[np.flatnonzero(scores[q] >= best), c].all()


def test_odd_rows(spark):
    """Nulls, repeated rows and ids, ties, vectors of other lengths, zeros, one hot vector, large numbers."""
    rng = random.Random(5)
    rows = [(i, i % 3 == 0, [rng.randrange(-2, 3) for _ in range(3)]) for i in range(60)] + [(500 + i, i % 10 == 0, [1, 1, 1]) for i in range(60)]
    rows += [(3, True, [1, 2, 3])] * 2 + [(3, True, [3, 2, 1]), (None, True, [2, 2, 2]), (None, None, [2, 2, 2]), (7, True, None), (8, True, [1, None, 2]), (9, True, []), (10, True, [5]), (11, True, [0, 0, 0, 4]), (12, False, [0, 0, 0])]
    assert run(spark, rows, pivots=6, group=9, block=20) == brute(rows, 5)
    wide = [(i, i % 2 == 0, [rng.randrange(-(2**29), 2**29) for _ in range(4)]) for i in range(40)]
    assert run(spark, wide, pivots=5) == brute(wide, 5)
    longer = [(i, i % 2 == 0, [rng.randrange(-(2**34), 2**34), rng.randrange(-(2**24), 2**24)]) for i in range(30)]
    with pytest.raises(ValueError, match="62 bits"):
        run(spark, longer)


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, False, [1, 2])]) == []
    assert run(spark, [(0, True, [1, 2])]) == []
    assert run(spark, [(0, True, [1, 2]), (1, False, [0, 1])]) == [(0, 1, 1, 2)]
    assert run(spark, [(i, True, []) for i in range(3)]) == brute([(i, True, []) for i in range(3)], 5)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rng.normal(0, 0.1, (200, 6)))] + [(250, [0.1, float("nan"), 0.0, 0.0, 0.0, 0.0], 0), (300, None, 1), (350, [float("inf")] * 6, 1), (400, [0.5, None], None)]
    spark.createDataFrame(values, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    f32 = lambda v: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
    rows = [(i, i % 50 == 0, f32(v)) for i, v, _ in values[:200]]
    assert sorted(map(tuple, ne.op13_exact_top_k(spark, str(tmp_path)).collect()), key=str) == brute(rows, 5)
