"""Search requests: rules, filters, reasons, excerpts."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import index, request
from larder.operators.request import Request

Q = ((1, "quick fox"), (2, "!!"), (3, "nothing"))
T = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize(
    "bad",
    [
        {"mode": "all"}, {"queries": ((1, " "),)}, {"queries": ()}, {"limit": 0}, {"limit": 51}, {"limit": True}, {"platforms": ()}, {"platforms": ["x"]}, {"platforms": ("x", "y")}, {"content_types": (" ",)}, {"folders": (1,)},
        {"published_since": datetime(2024, 1, 1)}, {"published_since": "2024-01-01T00:00:00"}, {"published_until": "soon"}, {"favorited_since": " "}, {"favorited_since": 5}, {"published_since": T, "published_until": T - timedelta(1)},
        {"favorited_since": "2024-01-02T00:00:00+01:00", "favorited_until": "2024-01-01T22:59:59Z"},
    ],
)
def test_refusals(bad):
    with pytest.raises(ValueError):
        Request(**{"queries": Q, **bad})


def items(spark):
    rows = [(i, "x" if i % 2 else "github", str(i), T + timedelta(milliseconds=i, microseconds=400), None if i == 4 else T, "available" if i < 6 else "unavailable", "text") for i in range(1, 8)]
    return spark.createDataFrame(rows, "doc_id long, platform string, source_id string, published_at timestamp, favorited_at timestamp, access_status string, content_type string").withColumn("published", F.col("published_at").cast("string"))


def test_filters(spark):
    ids = lambda **kw: sorted(r["doc_id"] for r in request.let_in(Request(Q, **kw), items(spark)).collect())
    assert ids() == [1, 2, 3, 4, 5] and ids(platforms=("x",)) == [1, 3, 5]
    assert ids(published_since=T + timedelta(milliseconds=2), published_until=T + timedelta(milliseconds=3)) == [2, 3]  # whole milliseconds
    assert ids(favorited_until="2024-01-01T01:00:00+01:00") == [1, 2, 3, 5]  # a missing date passes no bound


def test_answer(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "the quick brown fox " + "word " * 40, None, "content.md"), (1, 1, "fox fox", None, "../x.md"), (2, 0, "fox", None, "content.md"), (3, 0, "slow", None, "content.md"), (7, 0, "fox", None, "content.md")], "doc_id long, ordinal int, text string, heading string, path string")
    root = f"{tmp_path}/i"
    index.build(chunks, root)
    ok = request.let_in(Request(Q), items(spark))
    evidence = ok.select("doc_id", F.lit(1.0).alias("factor"))
    status = spark.createDataFrame([(0, 0)], "index_open int, embedding_open int")
    hits, why, mode = request.answer(spark, Request(Q), root, ok, request.safe_chunks(chunks), evidence, status)
    got = {(r["query_id"], r["doc_id"]): r for r in hits.collect()}
    assert set(got) == {(1, 1), (1, 2)} and mode == "fts" and got[1, 1]["ordinal"] == 0  # the unsafe chunk gives way
    assert got[1, 1]["citation"] == "item:x/1#chunk-0" and got[1, 1]["excerpt"].startswith("the quick") and got[1, 1]["excerpt"].endswith("…")
    assert {r["query_id"]: (r["ok"], r["reason"]) for r in why.collect()} == {1: (True, None), 2: (False, "no matching content; embedding_unavailable"), 3: (False, "no matching content; embedding_unavailable")}
    fts = request.answer(spark, Request(Q, mode="fts"), root, ok, chunks, evidence, status)[1]
    assert {r["query_id"]: r["reason"] for r in fts.collect()} == {1: None, 2: request.NO_TOKENS, 3: request.NO_MATCH}
    open_ = spark.createDataFrame([(1, 1)], "index_open int, embedding_open int")
    assert {r["query_id"]: r["reason"] for r in request.reasons(spark.createDataFrame(list(Q), "query_id int, text string"), hits, open_, None).collect()} == {1: None, 2: request.EMBEDDING_OPEN, 3: request.INDEX_OPEN}
    with pytest.raises(RuntimeError):
        request.answer(spark, Request(Q, mode="hybrid"), root, ok, chunks, evidence, status)
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (7, [1.0, 0.0])], "doc_id long, v array<double>")
    asked = spark.createDataFrame([(3, [1.0, 0.0])], "query_id int, q array<double>")
    both, _, mode = request.answer(spark, Request(Q, mode="hybrid"), root, ok, chunks, evidence, status, vectors, asked)
    assert mode == "hybrid" and {(r["query_id"], r["doc_id"]) for r in both.collect()} == {(1, 1), (1, 2), (3, 3)}


def test_newest_first(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.1Z", "soon", "2024-01-01T01:00:00+02:00", "later", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").orderBy(*request.newest_first(F.col("t")))
    assert [r[0] for r in df.collect()] == ["2024-01-01T00:00:00.1Z", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00+02:00", "soon", "later", None]


def test_folds_rules_and_evidence(spark):
    from larder.functions import fields
    from larder.operators import library

    one = lambda c: spark.range(1).select(c.alias("c")).first()[0]
    for text in ("Straße", "ΣΊΣΥΦΟΣ σίσυφος", "ﬁle ſ K İ ŉ", "plain ÄÖ", "", "ẞ"):
        assert one(fields.casefold(F.lit(text))) == text.casefold(), text
    body = "word " * 50
    faults = [one(fields.summary_fault(F.lit(b), F.lit(s))) for b, s in ((body, "s"), (body, body), ("short", "a longer one"), ("https://e.org/a", "s"), ("https://e.org/a\n## 媒体\n- long enough list", "s"), (None, "s"), ("abcd", "s"))]
    assert faults == [None, "not_shorter", None, "unreadable", "unreadable", "unreadable", None]
    tags = [one(fields.tags_fault(F.lit(b), F.array(F.lit(t)))) for b, t in (("检索 a", "jian"), ("检索 a", "检"), ("检 abc", "x"), ("", "x"))]
    assert tags == ["no_cjk", None, None, None]
    ev = [tuple(one(library.evidence_of(F.lit(b), F.array(*map(F.lit, p)).cast("array<string>")))) for b, p in ((" ", []), ("b", []), ("b", ["ocr/1.md"]), (None, ["transcript/a.md"]), ("b", ["ocr/../x.md", "assets/a.md", "/ocr/x"]))]
    assert ev == [("title_only", [], 0.75), ("body", ["body"], 0.95), ("mixed", ["body", "ocr"], 1.0), ("transcript", ["transcript"], 1.0), ("body", ["body"], 0.95)]


def test_import_replays_and_cuts(spark):
    from larder.operators import drivers, ingest
    from larder.streaming import ingest as stream

    names = [c for c in stream.ROWS.replace("\n", " ").split(", ") if not c.strip().startswith(("job_id", "key", "pos "))]
    row = lambda p, seq, sid, body="b": (p, sid, "u", "t", None, T, T, body, ["f"], "v", "available", None, seq)
    rows = spark.createDataFrame([row("x", i, f"i{i}") for i in range(45)] + [row("zhihu", i, f"z{i}") for i in range(5)], ", ".join(names) + ", seq long")
    old = spark.createDataFrame([("zhihu", ["z3", "older"])], "platform string, ids array<string>")
    none, empty = spark.createDataFrame([], stream.RECEIPT), spark.createDataFrame([], stream.STATE)
    out = drivers.import_scan(rows, old, empty, none, "j", span=10)
    assert {(r["platform"], r["key"]): r["scanned"] for r in out["receipts"].collect()} == {("x", "0"): 20, ("x", "1"): 20, ("x", "2"): 5, ("zhihu", "0"): 4}
    f = {r["platform"]: r["ids"] for r in out["frontiers"].collect()}
    assert f == {"x": [f"i{i}" for i in range(20)], "zhihu": ["z0", "z1", "z2", "z3", "older"]}
    again = drivers.import_scan(rows, old, ingest.upsert(empty, out["items"]), out["receipts"], "j", span=10)
    assert {r["verdict"] for r in again["verdicts"].collect()} == {"replay"} and again["items"].count() == 0
    capped = drivers.import_scan(rows, old, empty, none, "k", cap=25)
    assert {r["platform"]: r["status"] for r in capped["runs"].collect()} == {"x": "partial", "zhihu": "completed"}
    assert {r["platform"] for r in capped["frontiers"].collect()} == {"zhihu"}
    failed = drivers.fail_open(spark.createDataFrame([("j", "running"), ("k", "partial")], "job_id string, status string"), "lost")
    assert sorted(map(tuple, failed.collect())) == [("j", "failed", "lost"), ("k", "partial", None)]
