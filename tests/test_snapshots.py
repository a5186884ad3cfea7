"""Snapshots: records, folders, lookups, corrupt files, fixtures and item files."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from larder.sources import snapshots

T = datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
ITEM = "platform string, source_id string, canonical_url string, title string, author string, published_at timestamp, observed_at timestamp, body string, collections array<string>, extractor_version string, platform_metadata string, assets array<struct<relative_path:string,media_type:string,text:string,sha256:string>>"


def rows(spark):
    base = lambda p, i, **kw: (p, i, f"https://e.org/{i}", f"title {i}", kw.get("author"), T, T, 'bo"dy é\n', ["b", "a", "b"], "v1", kw.get("meta"), kw.get("assets", []))
    return spark.createDataFrame([base("x", "1"), base("x", "2", author="ann", meta='{"a": 1}', assets=[("ocr/1.md", "text/markdown", "é", "0")]), base("github", "o__r", meta="{}")], ITEM)


def test_record(spark):
    df = rows(spark)
    got = [json.loads(r[0]) for r in df.orderBy("platform", "source_id").select(snapshots.record(df)).collect()]
    assert list(got[1]) == ["schema_version", "platform", "source_id", "canonical_url", "title", "author", "published_at", "observed_at", "body", "collections", "extractor_version", "content_hash"]
    assert got[1]["author"] is None and got[1]["collections"] == ["a", "b"] and got[1]["published_at"] == "2024-01-02T03:04:05Z" and "platform_metadata" not in got[0]
    assert got[2]["platform_metadata"] == {"a": 1} and got[2]["assets"] == [{"relative_path": "ocr/1.md", "media_type": "text/markdown", "sha256": "0", "size_bytes": 2}]


def test_write_read_and_find_one_folder(spark, tmp_path):
    root = f"{tmp_path}/items"
    snapshots.write(rows(spark), root, 8)
    got = snapshots.read(spark, root)
    assert sorted((r["platform"], r["source_id"], tuple(r["errors"])) for r in got.collect()) == [("github", "o__r", ()), ("x", "1", ()), ("x", "2", ())]
    one = snapshots.find(spark, root, "x", "2", 8)
    assert [(r["source_id"], r["body"], r["published_at"].astimezone(UTC) if r["published_at"].tzinfo else r["published_at"]) for r in one.collect()][0][:2] == ("2", 'bo"dy é\n')
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "platform" in plan.split("PartitionFilters: [")[1].split("]")[0] and "bucket" in plan.split("PartitionFilters: [")[1].split("Pushed")[0]
    assert snapshots.find(spark, root, "x", "none", 8).count() == 0
    assert snapshots.sound(got).count() == 3


def folder(tmp_path, platform, name, text):
    d = tmp_path / "items" / platform / name
    d.mkdir(parents=True)
    (d / "source.json").write_text(text, encoding="utf-8")
    return d


def test_scan_reports_corrupt_and_misplaced_files(spark, tmp_path):
    df = rows(spark)
    text = {r["source_id"]: r["j"] for r in df.select("source_id", snapshots.record(df).alias("j")).collect()}
    folder(tmp_path, "x", "1", json.dumps(json.loads(text["1"]), indent=2))
    folder(tmp_path, "x", "other", text["2"])
    folder(tmp_path, "x", "3", "{not json")
    folder(tmp_path, "x", "4", text["1"].replace("title 1", "title 9").replace('"1"', '"4"'))
    got = {r["file_path"].split("/")[-2]: r["errors"] for r in snapshots.scan(spark, f"{tmp_path}/items").collect()}
    assert got == {"1": [], "other": ["folder"], "3": ["corrupt"], "4": ["content_hash"]}
    with pytest.raises(Exception, match="snapshot .*: "):
        snapshots.sound(snapshots.scan(spark, f"{tmp_path}/items")).collect()


def test_fixture(spark, tmp_path):
    item = {"platform": "x", "source_id": "1", "canonical_url": "https://e.org/1", "title": "t", "author": None, "published_at": "2024-01-02T03:04:05Z", "observed_at": "2024-01-02T03:04:05+00:00", "body": "b", "collections": [], "extractor_version": "v"}
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value)) and str(tmp_path / name)
    bad = {**item, "source_id": 5, "published_at": "2024-01-02T03:04:05", "collections": [1]}
    short = {k: v for k, v in item.items() if k != "body"}
    got = snapshots.fixture(spark, put("a.json", [item, bad, short, "no"])).orderBy("pos").collect()
    assert [r["errors"] for r in got[:3]] == [[], ["source_id", "collections", "published_at"], ["body"]] and "platform" in got[3]["errors"]
    for name, value in (("b.json", {}), ("c.json", []), ("d.json", "{")):
        with pytest.raises(ValueError):
            snapshots.fixture(spark, put(name, value))
    with pytest.raises(ValueError):
        snapshots.fixture(spark, f"{tmp_path}/none.json")


def test_markdown_files_and_get_item(spark, tmp_path):
    d = folder(tmp_path, "x", "1", "{}")
    for name in ("notes.md", "content.md", "Transcript/B.md", "transcript/a.md", "assets/x.md", "visual.md", "visual/x.md", "ocr/notes.md", "ocr/deep/1.md", "draft.md"):
        (d / name).parent.mkdir(exist_ok=True, parents=True)
        (d / name).write_text(name)
    files = snapshots.markdown_files(spark, f"{tmp_path}/items")
    assert [r["path"] for r in files.orderBy("place").collect()] == ["content.md", "ocr/deep/1.md", "transcript/a.md", "Transcript/B.md", "visual.md"]
    root = f"{tmp_path}/store"
    snapshots.write(rows(spark), root, 4)
    states = spark.createDataFrame([("x", "1", "unavailable", "video"), ("x", "2", "available", "text"), ("x", "gone", "available", "text")], "platform string, source_id string, access_status string, content_type string")
    got = {r["source_id"]: r for r in snapshots.get_item(snapshots.read(spark, root), files, states, content=True).collect()}
    assert set(got) == {"1", "2"} and got["1"]["files"][:2] == ["Transcript/B.md", "content.md"] and got["1"]["access_status"] == "unavailable"
    assert [c["path"] for c in got["1"]["content"]][0] == "content.md" and got["2"]["files"] == ["source.json"] and got["2"]["content"] is None


def test_empty_store(spark, tmp_path):
    snapshots.write(rows(spark).where(F.lit(False)), f"{tmp_path}/s", 4)
    assert snapshots.read(spark, f"{tmp_path}/s").count() == 0
