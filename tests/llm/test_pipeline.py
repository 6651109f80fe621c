"""The pipeline's stages, one after the other, against brute-force versions of each."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute as groups
from test_others import brute_items
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        if not gone:
            out.append((d, t))
        elif len(gone) < len(w):
            out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = docs.agg(F.max("doc_id")).head()[0]
    odd = spark.createDataFrame([(top + 1, None, "en", None, None), (top + 2, "", "fr", "s", 0), (top + 3, "123 ---", None, "s", 7), (top + 4, "the and of to is", None, None, 15)], docs.schema)
    return docs.unionByName(odd)


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs, want = tables, [(r.doc_id, r.text) for r in tables.collect()]
    items = {r.item_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "language":
            want = [(d, t) for d, t in want if any(map(str.isalpha, t or ""))]
        elif name == "near duplicates":
            kept = {d for d, _, c in groups(want, 5, 4, 5) if d == c}
            want = [(d, t) for d, t in want if d in kept]
        elif name == "repeated spans":
            want = without_repeats(want)
        elif name == "decontamination":
            want = [(d, t) for d, t in want if not brute_items(t, items)]
        if name == "packing":
            check_packing(docs.collect(), want, 4096)
        else:
            assert docs.columns == tables.columns
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name


def test_stages_of_an_empty_table(spark, tables):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, tables.limit(0), SF).count() == 0, name


def test_extra_columns_with_clashing_names_stay(spark, tables):
    more = tables.limit(60).withColumns({c: F.lit(7) for c in ("tag", "group", "n", "node", "items", "piece", "score", "contaminated", "__doc", "__tag", "__text", "__rows", "__covered", "__n_words")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns and out.count() > 0, name
        assert not out.where("tag <> 7 OR node <> 7 OR __doc <> 7 OR __text <> 7").count()
