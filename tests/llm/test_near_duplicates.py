import random
import re

import pytest
from framewright.llm.near_duplicates import miss_chance, near_duplicates, op2_near_duplicates, reachable

SF = "/root/testdata/sf0.001"


def brute(rows, width, num, den):
    """component of each row by texts' shingle sets, with unions over all pairs."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def made(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_default_misses_are_rare():
    assert miss_chance(64, 38, 0.85) < 2e-7 < miss_chance(64, 39, 0.85)


def test_op2_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = op2_near_duplicates(spark, SF)
    assert made(df) == brute(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


@pytest.fixture(scope="module")
def chains():
    """Near copies in chains (the ends are far apart), large groups, shared passages, odd rows."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, d = [], 0
    passage = [word() for _ in range(60)]
    for length, copies, edits in ((100, 40, 1), (60, 25, 1), (30, 30, 2), (200, 60, 3), (8, 20, 1)):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            base = list(base)
            for _ in range(edits):
                base[r.randrange(length)] = word()
            rows.append((d, " ".join(base)))
            d += 1
    for _ in range(60):
        rows.append((d, " ".join(passage + [word() for _ in range(r.choice((5, 15, 40)))])))
        d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \n"), (d + 3, "One two"), (d + 4, "one  TWO"), (d + 5, "one"), (d + 6, "x " * 30000)]
    rows += [rows[3], rows[3], (rows[5][0], "another text of that id"), (None, rows[7][1]), (None, "alone"), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,similarity", [(5, (4, 5)), (3, (17, 20)), (2, (1, 2))])
def test_chains_and_odd_rows(spark, chains, width, similarity):
    df = spark.createDataFrame([(*row, 1, "x") for row in chains], "doc_id long, text string, component_id int, node string")
    assert made(near_duplicates(df, width=width, similarity=similarity, block=16)) == brute(chains, width, *similarity)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def signatures(rng, base, count, changed):
    out = []
    for _ in range(count):
        s = bytearray(base)
        for k in rng.sample(range(64), rng.randrange(changed + 1)):
            s[k] = rng.randrange(256)
        out.append(bytes(s))
    return out


def test_members_out_of_reach_are_not_compared(spark):
    """Two large components of a list far apart: a few members at most are left of 4,000; every pair within reach is."""
    rng = random.Random(11)
    base = bytes(rng.randrange(256) for _ in range(64))
    other = bytes(b if k < 20 else (b + 1) % 256 for k, b in enumerate(base))  # 44 coordinates differ
    a, b = signatures(rng, base, 2000, 6), signatures(rng, other, 2000, 6)
    between = bytes(x if k % 2 else y for k, (x, y) in enumerate(zip(base, other)))  # within reach of both
    middle = [between, bytes(x if k < 62 else 255 - x for k, x in enumerate(between))]
    lists = {1: [("a", a), ("b", b)], 2: [("a", a[:300]), ("b", b[:300] + middle[:1]), ("c", middle[1:])], 3: [("a", a[:40]), ("b", b[:40]), ("c", signatures(rng, between, 40, 20)), ("d", signatures(rng, between, 5, 30))]}
    far = [bytes((x + 77) % 256 for x in base), bytes((x + 78) % 256 for x in other)]
    lists[4] = [("a", a[:300]), ("b", b[:300]), ("c", far[:1])]
    lists[5] = [*lists[4], ("d", far[1:])]  # two small components: they are compared with each other
    rows = [(key, f"{root}{k}".encode(), root.encode(), s) for key, parts in lists.items() for root, sigs in parts for k, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "key long, node binary, root binary, sig binary").repartition(3)
    got = {(r.key, bytes(r.node)) for r in reachable(df, 26, 20).collect()}
    assert not [x for x in got if x[0] == 1]
    for key in (2, 3, 4):
        own = [(n, r, s) for k, n, r, s in rows if k == key]
        for n, r, s in own:
            if any(r != q and sum(x != y for x, y in zip(s, t)) <= 26 for _, q, t in own):
                assert (key, n) in got, (key, n)
    assert not [x for x in got if x[0] == 4] and {x for x in got if x[0] == 5} == {(5, b"c0"), (5, b"d0")}


def test_large_components_in_one_list(spark):
    """Two groups of near copies that share most of a text and don't link, with a chain between some: blocks of eight."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(70)]
    rows, d = [], 0
    tails = [[word() for _ in range(30)] for _ in range(2)]
    for tail in tails:
        for _ in range(60):
            text = [*common, *tail]
            text[r.randrange(100)] = word()
            rows.append((d, " ".join(text)))
            d += 1
    for k in range(0, 31, 6):  # from one tail to the other
        rows.append((d, " ".join([*common, *tails[0][:k], *tails[1][k:]])))
        d += 1
    for part in (rows, rows[:120]):
        df = spark.createDataFrame(part, "doc_id long, text string")
        assert made(near_duplicates(df, block=8)) == brute(part, 5, 4, 5)
