"""Job claims: two runs at once, a killed run, stale claims, failures, empty outputs."""

import os
import threading
import time

import pytest
from framewright.sources import jobs


def work(folder, wait=0.0, bad=()):
    def run(row):
        with open(f"{folder}/log", "a") as log:
            log.write(f"{row['k']}\n")
        time.sleep(wait)
        if row["k"] in bad:
            raise ValueError("no good")
        return b"" if row["k"] == "empty" else f"out {row['k']}".encode()

    return run


def table(spark, names, parts=4):
    return spark.createDataFrame([(n,) for n in names], "k string").repartition(parts)


def done(df):
    return {r.key: (r.state, r.error) for r in df.collect()}


def test_two_runs_at_once_share_the_jobs(spark, tmp_path):
    folder, names, found = str(tmp_path), [f"job/{k}" for k in range(40)], {}
    df = table(spark, names, 2)

    def go(n):
        found[n] = done(jobs.run(df, "k", work(folder, 0.02), folder))

    threads = [threading.Thread(target=go, args=(n,)) for n in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ran = open(f"{folder}/log").read().split()
    assert sorted(ran) == sorted(names)  # each once
    for n in names:
        assert {found[0][n][0], found[1][n][0]} <= {"encoded", "locked", "skipped"} and [found[0][n][0], found[1][n][0]].count("encoded") == 1
    assert {r.bytes for r in jobs.outputs(spark, folder).collect()} == {9, 10} and jobs.outputs(spark, folder).where("done").count() == 40


def test_restart_after_a_killed_run(spark, tmp_path):
    """A run left a claim and half an output: the claim holds until it is stale, then the job runs again."""
    folder = str(tmp_path)
    claims = jobs.Claims(folder, 100)
    assert claims.take("b") and not claims.take("b")
    open(f"{folder}/outputs/.half", "w").write("x")
    assert done(jobs.run(table(spark, "abc"), "k", work(folder), folder, 100)) == {"a": ("encoded", None), "b": ("locked", None), "c": ("encoded", None)}
    past = time.time() - 200
    os.utime(claims.path("claims", "b"), (past, past))
    assert done(jobs.run(table(spark, "abc"), "k", work(folder), folder, 100)) == {"a": ("skipped", None), "b": ("encoded", None), "c": ("skipped", None)}
    assert not [f for f in os.listdir(f"{folder}/claims")]


def test_an_output_without_marker_is_not_done(spark, tmp_path):
    folder = str(tmp_path)
    claims = jobs.Claims(folder, 100)
    claims.finish("a", b"data")
    os.remove(claims.path("done", "a"))
    claims.finish("empty", b"")
    got = done(jobs.run(table(spark, ["a", "empty"]), "k", work(folder), folder))
    assert got == {"a": ("encoded", None), "empty": ("encoded", None)}
    assert done(jobs.run(table(spark, ["a", "empty"]), "k", work(folder), folder)) == {"a": ("skipped", None), "empty": ("encoded", None)}


def test_failures_and_odd_keys(spark, tmp_path):
    folder = str(tmp_path)
    names = ["../up", "ä b", ".", "x", "x_", "", "bad"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("x",)], "k string")
    got = jobs.run(df.coalesce(1), "k", work(folder, bad=("bad",)), folder).collect()
    states = sorted((r.key, r.state) for r in got)
    assert states == sorted([(n, "encoded") for n in names if n != "bad"] + [("bad", "failed"), ("x", "skipped")])
    assert [r.error for r in got if r.state == "failed"] == ["ValueError: no good"]
    assert len(os.listdir(f"{folder}/outputs")) == 6 and not os.listdir(f"{folder}/claims")
    assert done(jobs.run(table(spark, ["bad"]), "k", work(folder), folder)) == {"bad": ("encoded", None)}
    with pytest.raises(ValueError, match="shared file system"):
        jobs.local("s3://bucket/x")
