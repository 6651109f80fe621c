"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from framewright.llm import collocations as co


def brute(rows, longest, least, top, covered=(1, 2)):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        held = {g: a for g, a in f.items() if a >= least}
        around = Counter()
        for g, a in held.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    around[g[i : i + size]] = max(around[g[i : i + size]], a)
        found = []
        for g, a in held.items():
            if len(g) > 1 and not (g in around and around[g] * covered[1] >= a * covered[0]):
                score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(count, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "a", "b", "naïve", "日本", "x\x85y", "\x00", "-"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "  "]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), (None, ""), ("fr", " \t"), ("fr", "alone"), *[("en", "New York City, the")] * 30]


@pytest.mark.parametrize("longest, least, top, side, chunk", [(3, 3, 2000, 2, 400), (3, 10, 60, 2048, 1 << 21), (4, 2, 50, 4, 300), (2, 5, 100, 3, 1)])
def test_against_brute_force(spark, longest, least, top, side, chunk):
    rows = made(1200 if least == 10 else 120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = co.collocations(docs, longest=longest, least=least, top=top, side=side, chunk=chunk).collect()
    want = brute(rows, longest, least, top)
    assert len(want) > 15 and sorted(map(tuple, got)) == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, id long, x long, chunk long")
    assert co.collocations(empty).collect() == []
    rows = [("en", "w " * 200_000)] + [("en", None)]  # one very long text
    got = [tuple(r) for r in co.collocations(spark.createDataFrame(rows, "lang string, text string"), chunk=1000).collect()]
    assert got == brute(rows, 3, 10, 2000) and got[0][2] == "w w w"
    docs = spark.createDataFrame([(1, "a b. " * 10, "en", 7, 8, 9)], "doc_id long, text string, lang string, id long, x long, chunk long")
    assert [tuple(r) for r in co.collocations(docs).collect()] == [("en", 1, "a b", 10, 10, 10, 20, 1000000)]


def test_score_beyond_64_bits(spark):
    """The expression of the score on counts whose products need 38 digits."""
    a, left, right = 9 * 10**11, 9 * 10**11 + 7, 10**12 + 3
    sql = f"(1000000BD * (cast({a}L as decimal(15,0)) * cast({a}L as decimal(15,0)))) div (cast({left}L as decimal(15,0)) * cast({right}L as decimal(15,0)))"
    assert spark.sql(f"SELECT {sql} AS s").first().s == 1000000 * a * a // (left * right)


@pytest.mark.parametrize("side", [1, 2, 16, 2048])
def test_tiles(side):
    rng = np.random.default_rng(1)
    x, y = (np.minimum(rng.geometric(0.05, 20_000) - 1, 10**9) * rng.choice([1, 1, 5000], 20_000) for _ in "xy")
    keys, n = co.tiled_counts(x, y, side)
    assert dict(zip(keys.tolist(), n.tolist())) == Counter(((x << 32) | y).tolist()) and (np.diff(keys) > 0).all()
