"""Envelopes and routing of a browser extension's messages."""

import json

from pyspark.sql import functions as F

from larder.sources import protocol, variant


def message(payload=None, **kw):
    return {"protocolVersion": 1, "requestId": "r", "type": "capture.response", "payload": {} if payload is None else payload, **kw}


def codes(spark, *raw):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raw)]
    return [r["code"] for r in protocol.decode(spark.createDataFrame(rows, "i int, raw string")).orderBy("i").collect()]


def test_envelope(spark):
    bad = "invalid_message"
    got = codes(spark, message(), "", "[]", "{", None, json.dumps(message()) + "]", message(more=1), message(protocolVersion=2), message(protocolVersion=True), message(protocolVersion="1"), message(requestId=" "), message(requestId="x" * 65), message(type="other"), message(payload=[]), {"protocolVersion": 1})
    assert got == [None, bad, bad, bad, bad, bad, bad, "protocol_mismatch", bad, bad, bad, bad, bad, bad, bad]


def test_credentials_at_any_depth(spark):
    deep = {"a": 1}
    for _ in range(60):
        deep = {"x": [deep, {"y": "z"}]}
    worst = json.loads(json.dumps(deep).replace('"a": 1', '"Set-Cookie": 1'))
    said = {"text": 'a "token": "x", \\"cookie\\": ', "list": ['"token":', "token", ":"], "tokens": 1, "authToken": 2, "": 3}
    got = codes(spark, message(deep), message(worst), message(said), message({"x_csrf_y": 1}), message({"AUTH_TOKEN": 1}), message([{"token": 1}][0]), message({"a\"token\"": 1}), json.dumps(message({"t": 1})).replace('"t"', '"to\\u006ben"'))
    no = "credential_field_rejected"
    assert got == [None, no, None, no, no, no, no, no]


def test_sizes(spark, monkeypatch):
    monkeypatch.setattr(protocol, "MAX_TEXT", 10)
    large = "message_too_large"
    got = codes(spark, message({"a": ["x" * 10]}), message({"a": [{"b": "x" * 11}]}), message({"x" * 11: 1}), message({"a": "é" * 5}), message({"a": "é" * 6}), message({"a": '"\n\\' * 3}))
    assert got == [None, large, None, None, large, None]
    monkeypatch.setattr(protocol, "MAX_MESSAGE", 20)
    assert codes(spark, message()) == [large]


def test_routes(spark):
    ev = lambda session, **kw: ("j", session, json.dumps(kw))
    page = '{"data": []}'
    rows = [
        ev("x", platform="x", kind="x.bookmarks_page", body=page), ev("x", platform="x", kind="x.bookmarks_page", body={"data": 1}), ev("x", platform="x", kind="x.bookmarks_page", body="<html>"),
        ev("x", platform="zhihu", kind="zhihu.items_page", body=page), ev("zhihu", platform="zhihu", kind="x.bookmarks_page", body=page), ev("zhihu", platform="zhihu", kind="zhihu.items_page", scopeId="s", body=page),
        ev("zhihu", platform="zhihu", kind="zhihu.items_page", scopeId="t", body=page), ev("bilibili", platform="bilibili", kind="bilibili.video_bundle", scopeId="s", resource={"bvid": "B"}), ev("github", platform="github", kind="x", body=page), ev("x", kind="x.bookmarks_page"),
    ]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, job_id string, session_platform string, raw string").withColumn("payload", variant.decode(F.col("raw")))
    scopes = spark.createDataFrame([("j", "zhihu", "s"), ("j", "bilibili", "s"), ("k", "zhihu", "t")], "job_id string, platform string, scope_id string")
    got = [(r["route"], r["code"]) for r in protocol.route(events, scopes).orderBy("i").collect()]
    bad = (None, "invalid_message")
    assert got == [("x.bookmarks_page", None), ("x.bookmarks_page", None), (None, "page_changed"), bad, bad, ("zhihu.items_page", None), bad, ("bilibili.video_bundle", None), bad, bad]
