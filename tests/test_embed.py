"""Embedding builds: windows, providers, checks, commits."""

import hashlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import embed, ingest

PROFILE = embed.Profile("word-hashes", "1", "m", 16, hashlib.sha256(b"m").hexdigest(), 6, 2)


load = partial(embed.WordHashes, 16)


def test_windows():
    assert list(embed.spans(1000, 480, 32)) == [(0, 480), (448, 928), (896, 1000)]
    assert list(embed.spans(480, 480, 32)) == [(0, 480)] and list(embed.spans(0, 480, 32)) == [] and list(embed.spans(481, 480, 0)) == [(0, 480), (480, 481)]


def test_profile():
    good = ("p", "1", "m", 4, "0" * 64, 10, 2)
    assert embed.Profile(*good).id != embed.Profile(*good[:5], 10, 3).id
    for bad in ((" ", *good[1:]), (*good[:3], 0, *good[4:]), (*good[:3], True, *good[4:]), (*good[:4], "x", 10, 2), (*good[:5], 10, 10), (*good[:5], 10, -1)):
        with pytest.raises(ValueError):
            embed.Profile(*bad)
    with pytest.raises(ValueError):
        PROFILE.check(embed.WordHashes(17))


@pytest.mark.parametrize("vectors", [[[1.0, 0.0]] * 2, [[1.0]], [[1.0, float("nan")]], [[1.0, float("inf")]], [[0.0, 0.0]], [[True, 1.0]], [["1", 1.0]]])
def test_refused_vectors(vectors):
    with pytest.raises(ValueError):
        embed.checked(vectors, 1, 2)
    assert np.allclose(embed.checked([[3, 4.0]], 1, 2), [[0.6, 0.8]])


def test_segments_come_back_to_their_chunks(spark):
    rows = [(1, "k", " ".join(f"w{i}" for i in range(15))), (2, "k", None), (3, None, "one"), (4, "k", " \n ")]
    got = embed.segments(spark.createDataFrame(rows, "chunk_id long, extra string, text string"), load, PROFILE, call=3).orderBy("chunk_id", "segment").collect()
    assert [(r["chunk_id"], r["segment"], r["begin"], r["finish"]) for r in got] == [(1, 0, 0, 6), (1, 1, 4, 10), (1, 2, 8, 14), (1, 3, 12, 15), (3, 0, 0, 1)]
    assert got[1]["text"] == "w4 w5 w6 w7 w8 w9" and got[4]["extra"] is None
    expected = embed.checked(load().embed(["passage: w4 w5 w6 w7 w8 w9"]), 1, 16)[0]
    assert np.allclose(got[1]["vector"], expected)
    asked = embed.query_vectors(spark.createDataFrame([(1, "query: a"), (2, "a")], "query_id int, text string"), load, PROFILE).collect()
    assert asked[0]["q"] == asked[1]["q"] and len(asked) == 2  # the prefix is put once


def test_a_refused_call_marks_its_segments(spark):
    class Faulty(embed.WordHashes):
        def embed(self, texts):
            return [[float("nan")] * 16 if "bad" in t else v for t, v in zip(texts, super().embed(texts))]

    rows = spark.createDataFrame([(1, "fine"), (2, "bad one"), (3, "fine too")], "chunk_id long, text string").coalesce(1)
    got = {r["chunk_id"]: (r["error"], r["vector"] is None) for r in embed.segments(rows, lambda: Faulty(16), PROFILE, call=1).collect()}
    assert got[2] == ("vectors must hold finite numbers", True) and got[1] == got[3] == (None, False)
    with pytest.raises(Exception, match="query embedding"):
        embed.query_vectors(spark.createDataFrame([(1, "bad")], "query_id int, text string"), lambda: Faulty(16), PROFILE).collect()


def test_bytes(spark):
    v = [0.6, 0.8]
    df = spark.createDataFrame([(v,), ([0.6, 0.9],), (None,)], "v array<float>").select(embed.to_bytes(F.col("v")).alias("b"))
    got = [r[0] for r in df.select(embed.from_bytes(F.col("b"), 2)).collect()]
    assert np.allclose(got[0], v) and got[1] is None and got[2] is None
    assert df.first()["b"] == np.asarray(v, "<f4").tobytes() and df.select(embed.from_bytes(F.col("b"), 3)).first()[0] is None


def test_commit_checks_the_state_of_the_moment(spark):
    vec = [1.0, 0.0]
    made = spark.createDataFrame([(i, f"h{i}", 10 * i, 0, 0, 5, None if i == 6 else vec, "refused" if i == 6 else None) for i in range(1, 8)], "doc_id long, input_hash string, chunk_id long, segment int, begin int, finish int, vector array<float>, error string")
    items = spark.createDataFrame([(1, "h1", "available"), (2, "changed", "available"), (3, "h3", "unavailable"), (4, "h4", "available"), (5, "h5", "available"), (6, "h6", "available")], "doc_id long, index_hash string, access_status string")
    chunks = spark.createDataFrame([(1, 10, "h1"), (2, 20, "changed"), (3, 30, "h3"), (4, 99, "h4"), (5, 50, "h5"), (6, 60, "h6")], "doc_id long, chunk_id long, input_hash string")
    tasks = spark.createDataFrame([(i, f"h{i}", "index_content", "pending" if i == 5 else "completed") for i in range(1, 8)], "doc_id long, input_hash string, kind string, status string")
    tried = spark.createDataFrame([(2, 2), (3, 1)], "doc_id long, n int")
    out, states, log = embed.commit(made, items, chunks, tasks, tried, PROFILE, PROFILE.id)
    assert [r["doc_id"] for r in out.collect()] == [1]
    assert {r["doc_id"]: (r["status"], r["attempts"]) for r in states.collect()} == {1: ("completed", 1), 2: ("failed", 3), 3: ("pending", 2), 4: ("pending", 1), 5: ("pending", 1), 6: ("pending", 1), 7: ("pending", 1)}
    assert tuple(log.select("completed", "pending", "failed", "vectors", "status").first()) == (1, 5, 1, 1, "failed")
    assert {r["doc_id"] for r in embed.next_round(states).collect()} == {3, 4, 5, 6, 7}
    assert embed.commit(made, items, chunks, tasks, tried, PROFILE, "another")[0].count() == 0


def test_scope_results_and_status(spark):
    scopes = spark.createDataFrame([("j", "x", "b", "B", "running", False, None), ("j", "x", "a", "A", "running", False, 3)], "job_id string, platform string, scope_id string, name string, status string, cap_reached boolean, visible_total long")
    results = spark.createDataFrame([("j", "x", "a", True, 5, 1), ("j", "x", "a", False, None, 2), ("j", "x", "z", True, 1, 1)], "job_id string, platform string, scope_id string, cap_reached boolean, visible_total long, at int")
    got = {r["scope_id"]: (r["cap_reached"], r["visible_total"]) for r in ingest.apply_scope_results(scopes, results).collect()}
    assert got == {"a": (False, 3), "b": (False, None)}
    assert [r["scope_id"] for r in ingest.unknown_results(scopes, results).collect()] == ["z"]
    runs = spark.createDataFrame([("j", "x", "running"), ("j", "y", "paused")], "job_id string, platform string, status string")
    receipts = spark.createDataFrame([("j", "x", "a", 4, 1, 0, 2, 0), ("j", "x", None, 3, 3, 0, 0, 0)], "job_id string, platform string, scope_id string, scanned long, added long, refreshed long, duplicates long, out_of_range long")
    status = {r["platform"]: r for r in ingest.run_status(runs, scopes, receipts).collect()}
    assert (status["x"]["scanned"], status["x"]["added"]) == (7, 4) and [(s["scope_id"], s["scanned"]) for s in status["x"]["scopes"]] == [("a", 4), ("b", 0)]
    assert status["y"]["scanned"] == 0 and status["y"]["scopes"] is None
    shown = [spark.range(1).select(ingest.shown_embedding_state(F.lit("ready"), F.lit(p), F.lit(c), F.lit(n))).first()[0] for p, c, n in ((None, True, 0), ("p", False, 0), ("p", None, 0), ("p", True, 2), ("p", True, 0))]
    assert shown == ["disabled", "unavailable", "unavailable", "degraded", "ready"]
