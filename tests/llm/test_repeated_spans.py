import hashlib
import random
import re

import pytest
from framewright.llm.repeated_spans import SuffixAutomaton, op10_repeated_spans, remove_repeated

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if d is not None and (g not in first or d < first[g]):
                first[g] = d
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_automaton_against_all_substrings():
    r = random.Random(3)
    for _ in range(60):
        pieces = [(k, [r.choice("abc") for _ in range(r.randrange(1, 14))]) for k in range(5)]
        automaton = SuffixAutomaton()
        for k, p in pieces:
            automaton.add(p, k)
        query = [r.choice("abcd") for _ in range(20)]
        for least in (1, 2, 4):
            want = []
            for end in range(least, len(query) + 1):
                s = query[end - least : end]
                owners = [k for k, p in pieces if any(p[i : i + least] == s for i in range(len(p)))]
                if owners:
                    want.append((end, min(owners)))
            assert list(automaton.matches(query, least)) == want


def test_op10_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op10_repeated_spans(spark, SF).collect()), key=str)
    assert got == brute(rows, 50)


@pytest.mark.parametrize("options", [{}, {"block": 3, "slots": 64}, {"k": 2, "block": 2}])
def test_shared_passages_and_odd_rows(spark, options):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (9, 10, 12, 40)]
    rows = []
    for d in range(80):
        text = []
        for _ in range(r.randrange(4)):
            text += [word() for _ in range(r.randrange(8))] + r.choice(passages)
        rows.append((d, " ".join(text)))
    near = rows[-1][1].split() + ["end"] * 30
    for d in range(80, 110):
        near = list(near)
        near[r.randrange(len(near))] = word()
        rows.append((d, "\n".join(near)))
    rows += [(110, None), (111, ""), (112, " \t"), (113, "\x0bé " * 12), (114, "é\x0c" * 12), (115, "x " * 5000), (3, rows[9][1]), rows[4], rows[4], (None, rows[5][1]), (None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*row, 5, "y") for row in rows], "doc_id long, text string, n_words int, tag string").repartition(5)
    out = remove_repeated(df, window=10, **{"k": 4} | options).collect()
    got = sorted(((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.text.encode()).hexdigest()) for x in out), key=str)
    assert got == brute(rows, 10)
    for x in out:
        assert sum(s.words for s in x.spans) == x.n_removed


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
