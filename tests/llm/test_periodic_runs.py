"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from framewright.llm import periodic_runs as pr
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(words, least=2):
    """(start, length, period) by each period in turn; the smallest of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def one_by_one(texts):
    edges = np.cumsum([0, *map(len, texts)])
    start, stop, period = pr.runs_of(np.array([w for t in texts for w in t], np.int64), edges)
    own = np.searchsorted(start, edges)
    return [[(int(s - edges[k]), int(e - s), int(q)) for s, e, q in zip(start[a:b], stop[a:b], period[a:b])] for k, (a, b) in enumerate(zip(own[:-1], own[1:]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5))
def test_small_alphabets(texts):
    assert one_by_one(texts) == [brute(t) for t in texts]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("lot", [1, 7, 1 << 21])
def test_hard_words(monkeypatch, lot):
    """Words with many runs, none (overlap-free), one long one, and nested ones; in lots of any size."""
    monkeypatch.setattr(pr, "LOT", lot)
    morse = [bin(i).count("1") % 2 for i in range(256)]
    rng = random.Random(2)
    nested = ([1, 1, 1, 2] * 5 + [3]) * 6
    texts = [fibonacci(200), morse, [5] * 97, nested, list(range(60)), [], [4], [4, 4], [rng.randrange(2) for _ in range(150)]]
    assert one_by_one(texts) == [brute(t) for t in texts]


def test_operator(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "x  y\t" * 6 + "x", "\x85 é " * 9, "la la LA la " * 8]
    for _ in range(60):
        base = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        texts.append(" ".join([rng.choice("abcd") for _ in range(rng.randrange(30))] + base * rng.randrange(1, 9) + [rng.choice("ab") for _ in range(rng.randrange(30))]))
    rows = [(k if k % 7 else None, t, 1, "c") for k, t in enumerate(texts)] + [(1, "z " * 13, 2, "d")] * 2
    got = pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string"))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t, *_ in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        runs = brute(words, 12)
        want.append((i, len(words), runs, collapsed(words, runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()], key=key) == sorted(want, key=key)
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts(spark):
    """One run over 300,000 words; 300,000 words with a run of 1,000 each at period 500."""
    rng = random.Random(3)
    mixed = " ".join(str(rng.randrange(10**9)) if i % 1500 >= 1000 else f"{i // 1500}-{i % 1500 % 500}" for i in range(300_000))
    rows = {r.doc_id: r for r in pr.periodic_runs(spark.createDataFrame([(1, "ab " * 300_000), (2, mixed)], "doc_id long, text string")).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 300_000, 1)] and rows[1].collapsed == "ab"
    assert [tuple(x) for x in rows[2].runs] == [(1500 * k, 1000, 500) for k in range(200)]


def test_query(spark, tmp_path):
    """The query on a small table, with its edit, against brute force."""
    rng = random.Random(4)
    rows = [(k, None if k == 3 else " ".join(rng.choice(["u", "v", "w"]) for _ in range(rng.randrange(0, 70))), "en", "s", 0) for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t, *_ in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(k).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want.append((k, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(collapsed(words, runs))))
    got = pr.op12_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 10
