"""Ingest with replay, run states, queue, repairs and the stream."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import ingest, maintenance
from larder.streaming import ingest as stream

T0 = datetime(2024, 1, 1, tzinfo=UTC)
RUNS = "job_id string, platform string, status string, mode string, scanned long, cap long, since timestamp, until timestamp, truncated boolean"


def row(key, pos, sid, body="b", day=0, status="available", fav=None, job="j"):
    t = T0 + timedelta(days=day)
    return (job, "x", key, pos, sid, f"https://e.org/{sid}", "t", None, t, T0, body, ["f"], "v", status, fav)


def rows(spark, *r):
    return spark.createDataFrame(list(r), stream.ROWS)


def run(spark, mode="incremental", cap=None, status="running", since=None, until=None):
    return spark.createDataFrame([("j", "x", status, mode, 0, cap, since, until, False)], RUNS)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_submit_replay_and_conflict(spark):
    no_receipts, empty = spark.createDataFrame([], stream.RECEIPT), spark.createDataFrame([], stream.STATE)
    b = rows(spark, row("k1", 0, "1"), row("k1", 1, "2", day=40), row("k1", 2, "1"), row("k2", 0, "3", status="source_unavailable"))
    out = ingest.submit(b, no_receipts, run(spark, until=T0 + timedelta(days=30)), empty)
    assert got(out["receipts"], "key", "scanned", "added", "refreshed", "duplicates", "out_of_range", "truncated") == [("k1", 3, 1, 0, 1, 1, False), ("k2", 1, 1, 0, 0, 0, False)]
    assert got(out["items"], "source_id", "access_status") == [("1", "available"), ("3", "unavailable")]
    state, receipts = ingest.upsert(empty, out["items"]), out["receipts"]
    again = ingest.submit(b, receipts, run(spark), state)
    assert got(again["verdicts"], "key", "verdict") == [("k1", "replay"), ("k2", "replay")] and again["receipts"].count() == again["items"].count() == 0
    other = ingest.submit(rows(spark, row("k1", 0, "9"), row("k3", 0, "1", "new")), receipts, run(spark), state)
    assert got(other["verdicts"], "key", "verdict") == [("k1", "conflict"), ("k3", "accept")] and got(other["changes"], "change") == [("duplicate",)]
    ended = ingest.submit(rows(spark, row("k4", 0, "9"), row("k5", 0, "9", job="z")), receipts, run(spark, status="partial"), state)
    assert got(ended["verdicts"], "key", "verdict") == [("k4", "terminal"), ("k5", "unknown")]


def test_submit_full_refresh_and_cap(spark):
    empty = spark.createDataFrame([], stream.STATE)
    first = ingest.submit(rows(spark, row("k", 0, "1", fav=T0), row("k", 1, "2")), spark.createDataFrame([], stream.RECEIPT), run(spark), empty)
    state = ingest.upsert(empty, first["items"])
    b = rows(spark, row("m", 0, "1", "changed", fav=T0 + timedelta(1), status="login_required"), row("m", 1, "2"), row("n", 0, "3"), row("n", 1, "4"))
    out = ingest.submit(b, spark.createDataFrame([], stream.RECEIPT), run(spark, "full", cap=3), state)
    assert got(out["receipts"], "key", "scanned", "added", "refreshed", "duplicates", "truncated") == [("m", 2, 0, 1, 1, False), ("n", 1, 1, 0, 0, True)]
    now = {r.source_id: r for r in ingest.upsert(state, out["items"]).collect()}
    assert set(now) == {"1", "2", "3"}
    assert ingest.upsert(state, out["items"]).where(F.col("favorited_at") == F.lit(T0)).count() == 1  # the earlier favourite stays
    assert now["1"].access_status == "available"  # a passing failure flips nothing


def test_finish_frontiers_and_scopes(spark):
    ids = [str(i) for i in range(25)]
    f = spark.createDataFrame([("x", ["0", "old"])], "platform string, ids array<string>")
    res = lambda end, cap, i: spark.createDataFrame([("j", "x", end, cap, i)], "job_id string, platform string, observed_end boolean, cap_reached boolean, ids array<string>")
    runs, fr = ingest.finish(run(spark), res(True, False, ["9", "0"]), f)
    assert got(runs, "status") == [("completed",)] and fr.first().ids == ["9", "0", "old"]
    assert ingest.finish(run(spark, "full"), res(True, False, ids), f)[1].first().ids == ids[:20]
    runs, fr = ingest.finish(run(spark), res(True, True, ["9"]), f)
    assert got(runs, "status") == [("partial",)] and fr.first().ids == ["0", "old"]
    assert got(ingest.finish(run(spark, status="failed"), res(True, False, ["9"]), f)[0], "status") == [("failed",)]
    sr = spark.createDataFrame([("j", "z", "a", "running", "full"), ("j", "z", "b", "running", "full"), ("j", "z", "c", "failed", "full")], "job_id string, platform string, scope_id string, status string, mode string")
    rep = spark.createDataFrame([("j", "z", "a", ["1"])], "job_id string, platform string, scope_id string, ids array<string>")
    s, sf = ingest.finish_scopes(sr, rep, spark.createDataFrame([("z", "b", ["7"])], "platform string, scope_id string, ids array<string>"))
    assert got(s, "scope_id", "status") == [("a", "completed"), ("b", "partial"), ("c", "failed")] and got(sf, "scope_id", "ids") == [("a", ["1"]), ("b", ["7"])]
    names = "job_id string, platform string, scope_id string, name string"
    known, told = spark.createDataFrame([("j", "z", "a", "A"), ("j", "z", "b", "B"), ("j", "z", "c", "C")], names), spark.createDataFrame([("j", "z", "a", "A"), ("j", "z", "b", "X"), ("j", "z", "d", "D")], names)
    scanned = spark.createDataFrame([("j", "z", 0)], "job_id string, platform string, scanned long")
    assert got(ingest.register_scopes(known, told, scanned), "scope_id", "change") == [("a", "kept"), ("b", "renamed"), ("c", "dropped"), ("d", "added")]


def test_start_transitions_sessions_and_cut(spark):
    req = spark.createDataFrame([("j", "incremental", 5, None, None, ["x", "y"])], "job_id string, mode string, cap long, since timestamp, until timestamp, platforms array<string>")
    started = ingest.start(req, spark.createDataFrame([("x", ["1"])], "platform string, ids array<string>"))
    assert got(started, "platform", "frontier", "status") == [("x", ["1"], "running"), ("y", [], "running")]
    ev = spark.createDataFrame([("j", "x", 1, "pause"), ("j", "x", 2, "resume"), ("j", "x", 3, "fail"), ("j", "x", 4, "resume")], "job_id string, platform string, at int, event string")
    assert got(ingest.apply_transitions(started, ev, ingest.RUN), "platform", "status") == [("x", "failed"), ("y", "running")]
    ses = spark.createDataFrame([("a", "x", "running", T0), ("b", "x", "claimed", T0 + timedelta(seconds=100)), ("c", "y", "completed", T0)], "session_id string, platform string, status string, renewed timestamp")
    assert got(ingest.expire_sessions(ses, F.lit(T0 + timedelta(seconds=180)).cast("timestamp")), "session_id", "status") == [("a", "paused"), ("b", "claimed"), ("c", "completed")]
    assert got(ingest.open_session_conflicts(ses), "platform", "open") == [("x", 2)]
    scan = spark.createDataFrame([("j", "x", p // 2, p, str(9 - p)) for p in range(6)], "job_id string, platform string, page int, pos int, source_id string")
    fr = spark.createDataFrame([("j", "x", ["6", "5"])], "job_id string, platform string, ids array<string>")
    assert [ingest.cut_at_frontier(scan, fr, m).count() for m in ("before", "with", "page")] == [3, 4, 4] and ingest.cut_at_frontier(scan, fr.limit(0)).count() == 6
    obs = spark.createDataFrame([("s", "v", "detail", 1, "d1"), ("s", "v", "detail", 3, "d2"), ("s", "v", "entry", 2, "e")], "session_id string, id string, kind string, arrival int, payload string")
    assert got(ingest.fold_observations(obs), "id", "entry", "detail", "subtitle") == [("v", "e", "d2", None)]
    cap = spark.createDataFrame([("x", "1", "wrong_video"), ("x", "2", "wrong_video"), ("x", "3", "available")], "platform string, source_id string, subtitle_status string")
    held = spark.createDataFrame([("x", "1", True), ("x", "2", False)], "platform string, source_id string, has_transcript boolean")
    assert got(ingest.keep_transcripts(cap, held), "source_id") == [("2",), ("3",)]


def test_queue(spark):
    want = spark.createDataFrame([("x", "1", "summarize", "h1", 2), ("x", "1", "summarize", "h1", 3), ("y", "2", "summarize", "h2", 1)], "platform string, source_id string, kind string, input_hash string, created int")
    none = spark.createDataFrame([], "platform string, source_id string, kind string, input_hash string, created int, task_id string, status string")
    t = none.unionByName(maintenance.enqueue(none, want))
    assert t.count() == 2 and maintenance.enqueue(t, want).count() == 0
    first = maintenance.next_tasks(t, 1, "summarize").first()
    assert first.platform == "y" and maintenance.next_tasks(t, 5, "summarize", ["y"], [first.task_id]).count() == 0
    res = lambda o: spark.createDataFrame([(first.task_id, o)], "task_id string, outcome string")
    assert got(maintenance.settle(t, res("complete")), "status") == [("pending",)] * 2
    claimed = maintenance.settle(t, res("claim"))
    assert [got(maintenance.settle(claimed, res(o)), "platform", "status")[1][1] for o in ("complete", "fail", "decline")] == ["completed", "pending", "declined"]
    assert got(maintenance.recover(claimed), "status") == [("pending",)] * 2
    items = spark.createDataFrame([("x", "1", "h1", "available"), ("y", "2", "new", "available")], "platform string, source_id string, content_hash string, access_status string")
    assert got(maintenance.supersede(t, items), "platform", "status") == [("x", "pending"), ("y", "completed")]
    assert got(maintenance.apply_enrichment(t, items), "platform", "result") == [("x", "applied"), ("y", "stale")]
    assert got(maintenance.summaries_missing(items, t), "platform", "input_hash") == [("y", "new")]
    done = maintenance.settle(claimed, res("decline"))
    assert maintenance.redo(done, items.withColumn("model", F.lit("m")), declined=True).count() == 1 and maintenance.redo(done, items.withColumn("model", F.lit("m")), "m").count() == 0


def test_repairs(spark):
    items = spark.createDataFrame([("x", "1", "h", "available", None), ("x", "2", "h", "unavailable", T0), ("x", "3", "h", "missing", None), ("x", "4", "h", "available", None)], "platform string, source_id string, index_hash string, access_status string, favorited_at timestamp")
    snaps = spark.createDataFrame([("x", "1", T0, "source_unavailable"), ("x", "2", None, "login_required"), ("x", "3", None, "available"), ("x", "5", None, "available")], "platform string, source_id string, favorited_at timestamp, source_status string")
    assert got(maintenance.maintenance(snaps, items), "source_id", "action") == [("1", "keep"), ("2", "keep"), ("3", "repair"), ("4", "missing"), ("5", "register")]
    plan = maintenance.backfill(items, snaps)
    assert got(plan, "source_id", "access_status", "changed") == [("1", "unavailable", True), ("2", "unavailable", False), ("3", "missing", False)]
    assert tuple(maintenance.backfill_report(plan).first()) == (3, 1, 2, 2)
    chunks = spark.createDataFrame([("x", "1", "h", 0, "c0"), ("x", "1", "old", 1, "c1"), ("x", "4", "h", 0, "c4")], "platform string, source_id string, input_hash string, ordinal int, chunk_id string")
    assert got(maintenance.stale_indexes(items, chunks), "source_id") == [("1",)] and got(maintenance.stale_indexes(items, chunks, True), "source_id") == [("1",), ("4",)]
    tasks = spark.createDataFrame([("x", "4", "index_content", "h", "completed"), ("x", "1", "index_content", "h", "pending")], "platform string, source_id string, kind string, input_hash string, status string")
    ok = maintenance.eligible_chunks(chunks, items, tasks)
    assert got(ok, "chunk_id") == [("c4",)]
    vec = maintenance.valid_vectors(spark.createDataFrame([("c4", [0.6, 0.8]), ("c4", [1.0, 1.0]), ("c0", [float("nan"), 1.0]), ("c1", None)], "chunk_id string, vector array<float>"), 2)
    assert sorted(r.valid for r in vec.collect()) == [False, False, False, True]
    import hashlib

    embed = tasks.limit(0).union(spark.createDataFrame([("x", "4", "embed", hashlib.sha256(b"embed-v1\0p\0h").hexdigest(), "completed")], tasks.schema))
    assert maintenance.current_vectors(vec, ok, embed, "p").count() == 2 and maintenance.current_vectors(vec, ok, embed, "q").count() == 0
    assert maintenance.embedding_status(ok, vec.where("chunk_id = 'c4'"), embed).first().state == "degraded" and maintenance.embedding_status(ok, vec.where("valid"), embed).first().state == "ready"
    seg = "chunk_id string, begin int, finish int"
    assert got(maintenance.segment_faults(spark.createDataFrame([("a", 0, 5)], seg), spark.createDataFrame([("a", 0, 6)], seg)), "finish", "fault") == [(5, "missing"), (6, "extra")]
    fresh = spark.createDataFrame([("x", "1", "h", 0, "n0")], chunks.schema)
    assert got(ingest.replace_rows(chunks, fresh, fresh), "chunk_id") == [("c4",), ("n0",)]
    folders = "platform string, source_id string, name string"
    assert maintenance.add_folders(spark.createDataFrame([("x", "1", "a")], folders), spark.createDataFrame([("x", "1", "a"), ("x", "1", "b")], folders)).count() == 2
    c = spark.range(1).select(maintenance.counters(F.lit('{"scanned":3}')).alias("c"), maintenance.progress(F.lit(2), F.lit(6), F.lit(4)).alias("p"), maintenance.progress(F.lit(0), F.lit(6), F.lit(4)).alias("q")).first()
    assert (c.c.scanned, c.c.added, c.p.rate, c.p.left, c.q.left) == (3, 0, 0.5, 8.0, None)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(maintenance.counters(F.lit('{"added":-1}'))).collect()
    q = "question string, dimensions map<string,double>, covered int, claims int, hard_failure boolean"
    assert maintenance.rubric(spark.createDataFrame([("a", {"d": 4.0, "e": 3.0}, 9, 10, False), ("b", {"d": 2.0, "e": 3.0}, 0, 0, False)], q)).first().passed
    assert not maintenance.rubric(spark.createDataFrame([("a", {"d": 4.0}, 8, 10, False)], q)).first().passed
    b = maintenance.content_budget(spark.createDataFrame([("i", 1, "abc"), ("i", 2, "def")], "item string, n int, text string"), ["item"], ["n"], 4)
    assert got(b, "text", "truncated") == [("abc", False), ("d", True)]


def test_stream_replays_nothing(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "root")
    src.mkdir()

    def put(name, *rs):
        cols = [f.name for f in rows(spark, *rs).schema]
        (src / name).write_text("".join(json.dumps(dict(zip(cols, [v.isoformat() if isinstance(v, datetime) else v for v in r]))) + "\n" for r in rs))

    def go():
        stream.ingest_stream(spark, str(src), root, run(spark), str(tmp_path / "cp")).awaitTermination(120)

    put("a.json", row("k1", 0, "1"), row("k1", 1, "2"))
    go()
    put("b.json", row("k1", 0, "1"), row("k1", 1, "2"))  # sent again
    put("c.json", row("k2", 0, "2"), row("k2", 1, "3"))
    go()
    state = stream.read_log(spark, f"{root}/items", stream.STATE, ingest.ITEM)
    receipts = stream.read_log(spark, f"{root}/receipts", stream.RECEIPT, ingest.BATCH)
    assert got(state, "source_id") == [("1",), ("2",), ("3",)]
    assert got(receipts, "key", "added", "duplicates") == [("k1", 2, 0), ("k2", 1, 1)]


def test_lease_stream(spark, tmp_path):
    src = tmp_path / "beats"
    spark.createDataFrame([("s", T0 + timedelta(seconds=x)) for x in (0, 100, 200, 500)] + [("late", T0 + timedelta(days=1))], "session_id string, at timestamp").write.parquet(str(src))
    beats = spark.readStream.schema("session_id string, at timestamp").parquet(str(src))
    q = stream.lease_stream(beats).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got(spark.table("leases").where("session_id = 's'"), "beats") == [(1,), (3,)]


def test_batches_count_in_order_of_arrival(spark):
    none, empty = spark.createDataFrame([], stream.RECEIPT), spark.createDataFrame([], stream.STATE)
    b = rows(spark, *[row(k, i, f"{k}-{i}", body=f"b{k}") for k in ("10", "2", "9") for i in range(3)], row("10", 3, "same", "late"), row("9", 3, "same", "early"))
    out = ingest.submit(b, none, run(spark, cap=6), empty)
    assert got(out["receipts"], "key", "scanned", "truncated") == [("10", 0, True), ("2", 3, False), ("9", 3, True)]
    whole = ingest.submit(b, none, run(spark, "full"), empty)
    changes = {(r["key"], r["source_id"]): (r["change"], r["content_hash"]) for r in whole["changes"].collect()}
    assert changes["9", "same"][0] == "added" and changes["10", "same"][0] == "refreshed"
    assert {r["source_id"]: r["content_hash"] for r in whole["items"].collect()}["same"] == changes["10", "same"][1]
    told = {"10": 1, "2": 2, "9": 3}
    numbered = b.withColumn("arrival", F.element_at(F.create_map(*[F.lit(x) for kv in told.items() for x in kv]), F.col("key")))
    assert got(ingest.submit(numbered, none, run(spark, cap=5), empty)["receipts"], "key", "scanned") == [("10", 4), ("2", 1), ("9", 0)]


def test_one_key_twice_in_a_call(spark):
    none, empty = spark.createDataFrame([], stream.RECEIPT), spark.createDataFrame([], stream.STATE)
    b = rows(spark, row("k", 0, "1"), row("k", 0, "1"), row("k", 0, "2"), row("z", 0, "3", job="gone"), row("z", 0, "4", job="gone"))
    pairs = [(tuple(r), a) for r, a in zip(b.collect(), (1, 2, 3, 1, 2))]
    b = spark.createDataFrame([(*r, a) for r, a in pairs], stream.ROWS + ", arrival long")
    out = ingest.submit(b, none, run(spark), empty)
    assert got(out["verdicts"], "key", "arrival", "verdict") == [("k", 1, "accept"), ("k", 2, "replay"), ("k", 3, "conflict"), ("z", 1, "unknown"), ("z", 2, "unknown")]
    assert got(out["items"], "source_id") == [("1",)] and got(out["receipts"], "key", "scanned") == [("k", 1)]


def test_runs_that_end_together_move_the_frontier_in_order(spark):
    runs = spark.createDataFrame([("a", "x", "running", "incremental", False), ("b", "x", "running", "full", False), ("c", "x", "running", "incremental", False)], "job_id string, platform string, status string, mode string, truncated boolean")
    res = spark.createDataFrame([("a", "x", True, False, ["a"], T0 + timedelta(2)), ("b", "x", True, False, ["b"], T0), ("c", "x", True, False, ["c", "b"], T0 + timedelta(1))], "job_id string, platform string, observed_end boolean, cap_reached boolean, ids array<string>, ended timestamp")
    old = spark.createDataFrame([("x", ["old"])], "platform string, ids array<string>")
    assert ingest.finish(runs, res, old)[1].first()["ids"] == ["a", "c", "b"]


def test_stream_compacts_and_orders_files(spark, tmp_path):
    src, root = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    import os

    def put(name, when, *items):
        part = rows(spark, *items).selectExpr("to_json(struct(*)) as j").collect()
        (src / name).write_text("\n".join(r["j"] for r in part))
        os.utime(src / name, (when, when))

    for n in range(5):
        put(f"f{n}.json", 1000 + n, row(f"k{n}", 0, "same", body=f"b{n}"), row(f"k{n}", 1, f"own{n}"))
    stream.ingest_stream(spark, str(src), root, run(spark, "full"), str(tmp_path / "cp"), files=1, every=2).awaitTermination(200)
    put("z.json", 2000, row("k9", 0, "same", body="first"))
    put("a.json", 3000, row("k9", 0, "same", body="second"))
    stream.ingest_stream(spark, str(src), root, run(spark, "full"), str(tmp_path / "cp"), every=2).awaitTermination(200)
    assert {r[0] for r in spark.read.parquet(f"{root}/items_marks").collect()} == {-1, 2, 4}
    state = {r["source_id"]: r["content_hash"] for r in stream.read_log(spark, f"{root}/items", stream.STATE, ingest.ITEM).collect()}
    assert set(state) == {"same", *(f"own{n}" for n in range(5))}
    first = rows(spark, row("k9", 0, "same", body="first")).select(ingest.content_hash().alias("h")).first()["h"]
    assert state["same"] == first  # the later file has the same key and another payload: a conflict
    assert {r["key"] for r in stream.read_log(spark, f"{root}/receipts", stream.RECEIPT, ingest.BATCH).collect()} == {"k0", "k1", "k2", "k3", "k4", "k9"}
