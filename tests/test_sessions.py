"""Capture sessions as a stream: states, leases, batches and restarts."""

from datetime import UTC, datetime, timedelta

import pytest

from larder.streaming import sessions

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def events(*rows):
    """(session, platform, seconds, kind, item)"""
    return [(s, p, i, T0 + timedelta(seconds=t), k, x) for i, (s, p, t, k, x) in enumerate(rows)]


def feed(spark, path, rows):
    spark.createDataFrame(rows, sessions.EVENT).coalesce(1).write.mode("append").parquet(str(path))


def drain(spark, tmp):
    q = sessions.run(spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/check", files=1)
    q.awaitTermination(200)
    assert q.exception() is None
    return spark.read.schema(sessions.OUT).parquet(f"{tmp}/out").collect()


def test_transitions():
    all_ = (*sessions.OPEN, *sessions.TERMINAL)
    table = {k: {s: sessions.step(s, k) for s in all_} for k in ("claim", "item", "renew", "pause", "complete", "fail", "cancel")}
    assert table["claim"] == dict.fromkeys(sessions.OPEN, "capturing") | dict.fromkeys(sessions.TERMINAL)
    assert table["item"] == table["renew"] == dict.fromkeys(all_) | {"capturing": "capturing"}
    assert table["pause"] == dict.fromkeys(sessions.OPEN, "paused") | dict.fromkeys(sessions.TERMINAL)
    assert table["complete"] == dict.fromkeys(all_) | {"capturing": "completed", "completed": "completed"}
    assert table["cancel"] == dict.fromkeys(sessions.OPEN, "cancelled") | {"completed": None, "failed": None, "cancelled": "cancelled"}
    assert table["fail"]["failed"] == "failed" and table["fail"]["completed"] is None


def test_flush_restart_and_leases(spark, tmp_path):
    one = [(1, "x", 0, "claim", None), *[(1, "x", 1 + i, "item", f"a{i}") for i in range(19)], (2, "zhihu", 0, "claim", None), *[(2, "zhihu", 1 + i, "item", f"z{i}") for i in range(25)], (3, "x", 0, "item", "early"), (4, "x", 0, "claim", None), (4, "x", 5, "item", "lost"), (5, "x", 0, "claim", None), (5, "x", 1, "item", "k")]
    feed(spark, tmp_path / "in", events(*one))
    first = drain(spark, tmp_path)
    assert not [r for r in first if r["what"] == "batch"]  # 19 held, and a scoped platform holds all
    assert [(r["session_id"], r["status"]) for r in first if r["what"] == "refused"] == [(3, "awaiting_browser")]
    two = [(1, "x", 30 + i, "item", f"b{i}") for i in range(3)] + [(1, "x", 60, "complete", None), (1, "x", 61, "complete", None), (1, "x", 62, "item", "late"), (2, "zhihu", 40, "complete", None), (4, "x", 50, "cancel", None)]
    feed(spark, tmp_path / "in", events(*two))
    third = [(9, "x", 1000, "claim", None), (5, "x", 1001, "item", "no"), (5, "x", 1002, "claim", None), (5, "x", 1003, "item", "yes"), (5, "x", 1004, "complete", None)]
    drain(spark, tmp_path)  # restarted from the checkpoint
    feed(spark, tmp_path / "in", events(*third))
    got = drain(spark, tmp_path)
    batches = {(r["session_id"], r["number"]): r["items"] for r in got if r["what"] == "batch"}
    assert batches == {(1, 0): [f"a{i}" for i in range(19)] + ["b0"], (1, 1): ["b1", "b2"], (2, 0): [f"z{i}" for i in range(20)], (2, 1): [f"z{i}" for i in range(20, 25)], (5, 0): ["k", "yes"]}
    assert [(r["session_id"], r["at"].astimezone(UTC)) for r in got if r["what"] == "expired" and r["session_id"] == 5] == [(5, T0 + timedelta(seconds=181))]
    assert {r["session_id"]: r["status"] for r in sorted((r for r in got if r["what"] == "status"), key=lambda r: r["at"])} == {1: "completed", 2: "completed", 4: "cancelled", 5: "completed", 9: "capturing"}
    assert {(r["session_id"], r["status"]) for r in got if r["what"] == "refused"} == {(3, "awaiting_browser"), (1, "completed"), (5, "paused")}


def test_timer_reports_a_lease_without_events(spark, tmp_path):
    feed(spark, tmp_path / "in", events((1, "x", 0, "claim", None), (2, "x", 0, "claim", None)))
    drain(spark, tmp_path)
    feed(spark, tmp_path / "in", events((2, "x", 170, "renew", None), (3, "x", 400, "claim", None)))
    drain(spark, tmp_path)
    feed(spark, tmp_path / "in", events((3, "x", 401, "renew", None)))
    got = drain(spark, tmp_path)
    assert sorted((r["session_id"], r["at"].astimezone(UTC)) for r in got if r["what"] == "expired") == [(1, T0 + timedelta(seconds=180)), (2, T0 + timedelta(seconds=350))]


def test_store_setting_is_left_alone(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    feed(spark, tmp_path / "in", events((1, "x", 0, "claim", None)))
    drain(spark, tmp_path)
    assert spark.conf.get(name, None) == before
    with pytest.raises(KeyError):
        sessions.ENDS["claim"]
