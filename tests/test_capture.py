"""Pages, mapping, Markdown, HTML, hashes and checks, on pages made here."""

import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from larder.functions import fields, hashes, markup
from larder.operators import mapping, validate
from larder.sources import pages


def parsed(spark, parser, *bodies, **kw):
    df = spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)], "page int, body string")
    return parser(df, **kw).orderBy("page").collect()


def test_bilibili_folders_and_codes(spark):
    ok = {"code": 0, "data": {"list": [{"id": 12, "title": "tools", "media_count": 3}]}}
    got = parsed(spark, pages.bilibili_folders, ok, {"code": -101}, {"code": 5, "data": {}}, {"code": True}, "no json", None, {"code": 0, "data": {"list": [{"id": "12", "title": "x", "media_count": 1}]}}, {"data": {"list": []}}, [1])
    assert [r.code for r in got] == [None, "login_required", "page_changed", "page_changed", "page_changed", "page_changed", "page_changed", None, "page_changed"]
    assert [tuple(f) for f in got[0].folders] == [("12", "tools", 3)] and got[7].folders == [] and got[1].folders is None


def test_bilibili_resources(spark):
    m = {"bvid": "", "bv_id": "BV1", "title": "a", "pubtime": 1700000000, "fav_time": "soon", "upper": {"mid": 5, "name": "n"}, "intro": None}
    got = parsed(spark, pages.bilibili_resources, {"data": {"medias": [m, m | {"bvid": "BV2", "fav_time": 1.5}], "has_more": True}}, {"data": {"medias": [m | {"pubtime": None}]}}, {"data": {"medias": [m], "has_more": 1}}, {"data": {"medias": []}})
    a, b = got[0].medias
    assert (a.bvid, a.author, a.author_mid, a.intro, a.fav_time, got[0].has_more) == ("BV1", "n", "5", "", None, True) and b.bvid == "BV2" and b.fav_time.microsecond == 500000
    assert [r.code for r in got] == [None, "page_changed", "page_changed", None] and got[3].has_more is False
    one = parsed(spark, pages.bilibili_media, m, m | {"title": " "})
    assert one[0].media == a and one[1].code == "page_changed"


def test_bilibili_detail_and_subtitle(spark):
    d = {"bvid": "BV1", "title": "t", "pubdate": 0, "owner": {"mid": "x", "name": "n"}, "duration": 9}
    got = parsed(spark, pages.bilibili_detail, {"code": 0, "data": d}, {"code": -404}, {"code": -400}, {"data": d | {"aid": "1"}})
    assert [r.code for r in got] == [None, "source_unavailable", "login_required", "page_changed"] and got[0].video.duration == 9 and got[0].video.author_mid is None
    cue = lambda a, b, c: {"from": a, "to": b, "content": c}
    got = parsed(spark, pages.bilibili_subtitle, {"lang": "zh", "body": [cue(2, 3, "b"), cue(1.5, 2, "a"), cue(2, 3, "b")]}, {"body": []}, {"body": [cue("1", 2, "x")]}, {"code": 7, "body": []}, {"code": -101}, {"body": [cue(0, 1, "")]})
    assert [r.code for r in got] == [None, "subtitle_unavailable", "malformed_subtitle", "malformed_subtitle", "login_required", None]
    assert [tuple(c) for c in got[0].cues] == [(1.5, 2.0, "a"), (2.0, 3.0, "b")] and got[0].language == "zh" and got[5].language == "unknown"


def tweet(i, **more):
    user = {"result": {"core": {"name": "Ann", "screen_name": "ann"}}}
    return {"__typename": "Tweet", "rest_id": str(i), "core": {"user_results": user}, "legacy": {"full_text": f"text {i}", "created_at": "Wed Oct 10 20:19:24 +0000 2018"}} | more


def bookmarks(*results, kind="TimelineTimelineItem"):
    entries = [{"entryId": f"tweet-{i}", "content": {"entryType": kind, "itemContent": {"tweet_results": {"result": r} if r else {}}}} for i, r in enumerate(results)]
    entries.append({"entryId": "c", "content": {"entryType": "TimelineTimelineCursor", "cursorType": "Bottom", "value": "next"}})
    return {"data": {"bookmark_timeline_v2": {"timeline": {"instructions": [{"type": "TimelineClearCache"}, {"type": "TimelineAddEntries", "entries": entries}]}}}}


def test_x_bookmarks(spark):
    note = {"note_tweet": {"note_tweet_results": {"result": {"text": "long text"}}}}
    pic = tweet(3)
    pic["legacy"]["extended_entities"] = {"media": [{"type": "photo", "media_url_https": "https://p/1", "ext_alt_text": " "}]}
    old = tweet(4, core={"user_results": {"result": {"legacy": {"name": "Old", "screen_name": "old"}}}}, quoted_status_result={"result": {"__typename": "TweetTombstone"}})
    stone = {"__typename": "TweetTombstone", "tombstone": {"text": {"text": "gone"}}}
    page = bookmarks(tweet(1, **note), {"__typename": "TweetWithVisibilityResults", "tweet": tweet(2)}, pic, old, stone, None)
    bad = tweet(1)
    bad["legacy"]["created_at"] = "2018"
    got = parsed(spark, pages.x_bookmarks, page, {"errors": [{"code": 32, "message": ""}]}, {"errors": [{"code": 1, "message": "x"}]}, bookmarks(tweet(1), kind="Odd"), bookmarks(bad), bookmarks(), bookmarks({"__typename": "Advert"}))
    assert [r.code for r in got] == [None, "login_required", "page_changed", "page_changed", "page_changed", None, "page_changed"]
    t = got[0].tweets
    assert [x.text for x in t] == ["long text", "text 2", "text 3", "text 4", None, None] and [x.tombstone for x in t] == [False] * 4 + [True] * 2
    assert (t[2].media[0].url, t[2].media[0].alt, t[3].author, t[3].handle, t[3].quoted.unavailable, t[4].tweet_id, t[4].reason, t[5].reason) == ("https://p/1", None, "Old", "old", True, "4", "gone", "empty tweet result")
    assert got[0].bottom_cursor == "next" and got[0].has_more and not got[5].has_more


def test_zhihu(spark):
    answer = {"type": "answer", "id": 7, "url": "https://z/7", "content": "<p>hi</p>", "question": {"id": "9", "title": "why"}, "author": {"name": "A"}, "voteup_count": 3, "created_time": 1600000000}
    article = {"type": "article", "id": "8", "url": "https://z/8", "title": "own", "created": 1600000000}
    other = {"type": "pin", "title": "p", "url": None}
    item = lambda c: {"created": "2024-01-02T03:04:05Z", "content": c}
    page = {"data": [item(answer), item(article), item(other)], "paging": {"is_end": False}}
    got = parsed(spark, pages.zhihu_items, page, page | {"paging": {}}, {"error": {"code": 100}}, {"error": {"message": "请求频繁"}}, {"error": {"name": "x"}}, {"data": [item(answer | {"url": "ftp"})], "paging": {"is_end": True}}, {"data": [{"created": "2024-01-02", "content": other}], "paging": {"is_end": True}})
    assert [r.code for r in got] == [None, "page_changed", "login_required", "rate_limited", "page_changed", "page_changed", "page_changed"]
    a, b, c = got[0].favorites
    assert (a.kind, a.item_id, a.title, a.question_id, b.title, c.kind, c.type_raw) == ("answer", "7", "why", "9", "own", "other", "pin")
    assert c.item_id == hashlib.sha256(b"pin||p").hexdigest()[:16]
    cols = parsed(spark, pages.zhihu_collections, {"data": [{"id": 1, "title": "c", "item_count": None, "is_default": True}]}, {"data": [{"id": True, "title": "c"}]})
    assert tuple(cols[0].collections[0]) == ("1", "c", 0, True) and cols[1].code == "page_changed"
    rows = spark.createDataFrame([(1, json.dumps(page))], "page int, body string")
    items = mapping.zhihu(pages.zhihu_items(rows).select(F.explode("favorites").alias("f")).select("f.*", F.array(F.lit("c")).alias("collections")), F.lit("2024-05-01").cast("timestamp")).orderBy("source_id").collect()
    assert [(r.source_id, r.title, r.body) for r in items] == [("answer-7", "why", "hi"), ("article-8", "own", ""), (f"pin-{c.item_id}", "p", "")]
    assert items[2].canonical_url == f"https://www.zhihu.com/pin/{c.item_id}" and json.loads(items[0].platform_metadata)["question_id"] == "9"


def test_github(spark):
    star = {"starred_at": "2024-01-02T03:04:05Z", "repo": {"full_name": "o/r", "html_url": "https://g/o/r", "default_branch": "main", "created_at": "2020-01-01T00:00:00Z", "topics": ["a", 1, "b"], "description": " d ", "stargazers_count": 4}}
    got = parsed(spark, pages.github_starred, [star], {"message": "API rate limit exceeded"}, {"message": "Not Found"}, {"x": 1}, [{"repo": {}}], [])
    assert [r.code for r in got] == [None, "rate_limited", "source_unavailable", "page_changed", "page_changed", None] and got[0].stars[0].owner == "o"
    stars = pages.github_starred(spark.createDataFrame([(json.dumps([star]),)], "body string")).select(F.explode("stars").alias("s")).select("s.*")
    readme = "x" * (mapping.README_BYTES - 1) + "é!"
    r = mapping.github(stars, F.lit("2024-05-01").cast("timestamp"), F.lit(readme)).first()
    assert (r.source_id, r.author, json.loads(r.platform_metadata)["readme_status"]) == ("o__r", "o", "truncated")
    assert r.body == "d\n\n主题：a · b\n\n## README\n\n" + "x" * (mapping.README_BYTES - 1)


def test_x_and_bilibili_items(spark):
    rows = spark.createDataFrame([(json.dumps(bookmarks(tweet(1), None)),)], "body string")
    tweets = pages.x_bookmarks(rows).select(F.explode("tweets").alias("t")).select("t.*")
    a, b = mapping.x(tweets, F.lit("2024-05-01").cast("timestamp")).orderBy("source_id", ascending=False).collect()
    assert (a.canonical_url, a.title, a.body, b.title, b.body, b.canonical_url) == ("https://x.com/ann/status/1", "text 1", "text 1", "已失效推文 1", "", "https://x.com/i/web/status/1") or a.source_id == b.source_id
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    entry = "struct<title:string,author:string,author_mid:string,intro:string,cover_url:string,published_at:timestamp>"
    seen = spark.createDataFrame([("BV1", "s1", t0, 2, ("late", "n", None, " i ", None, t0)), ("BV1", "s2", t0, 1, ("first", "n", None, " i ", None, t0))], f"bvid string, folder string, fav timestamp, seq int, entry {entry}")
    obs = mapping.favourites(seen, "bvid", "folder", "fav", "seq", "entry")
    details = spark.createDataFrame([("BV1", "login_required", None)], "bvid string, code string, video struct<title:string,author:string,author_mid:string,description:string,cover_url:string,published_at:timestamp,duration:long>")
    subs = spark.createDataFrame([("BV1", None, "zh-CN!", [(0.0005, 3661.0015, "hi")], "{}", "s", None, None)], "bvid string, code string, language string, cues array<struct<start:double,end:double,content:string>>, raw string, source string, offered string, asked string")
    r = mapping.bilibili(obs, details, subs, F.lit("2024-05-01").cast("timestamp")).first()
    assert (r.title, r.collections, r.body) == ("first", ["s1", "s2"], "i\n\n## 字幕（zh-CN!）\n[00:00] hi")
    assert r.assets[0].text == "# Transcript（zh-CN!）\n\n[00:00:00.000 --> 01:01:01.002] hi\n" and r.assets[1].relative_path == "assets/subtitles/zh-CN.json"
    assert json.loads(r.platform_metadata)["source_status"] == "login_required"


def test_markdown_chunks(spark):
    text = "intro\n\n# A\n\n\npara\nmore\n\nnext\n```py\n# no heading\n```\n## B ##\n# C\ntail"
    got = [c[1:] for c in markup.chunks_of(text)]
    assert got == [(1, 1, None, "intro"), (3, 9, "A", "# A\n\n\npara\nmore\n\nnext"), (10, 12, "A", "```py\n# no heading\n```"), (13, 13, "B", "## B ##"), (14, 15, "C", "# C\ntail")]
    assert [len(c[4]) for c in markup.chunks_of("x" * 1201)] == [1200, 121] and len(markup.chunks_of("😀" * 1200)) == 1
    assert [c[1:3] for c in markup.chunks_of("aaaa\nbbbb\ncccc", 8, 2)] == [(1, 2), (2, 3), (2, 3)][: len(markup.chunks_of("aaaa\nbbbb\ncccc", 8, 2))]
    assert markup.chunks_of(None) == markup.chunks_of(" \n ") == [] and markup.chunks_of("```\nopen\n\nend")[0][1:3] == (1, 4)
    files = spark.createDataFrame([("i", p, t) for p, t in (("ocr/B.md", "o"), ("content.md", "c1\n\n# h\nc2"), ("notes.md", "n"), ("transcript/a.md", "t"), ("assets/x.md", "a"), ("ocr/x.txt", "z"))], "item string, path string, text string")
    chunks = markup.number_chunks(markup.markdown_chunks(markup.index_files(files)), ["item"]).orderBy("ordinal").collect()
    assert [(c.ordinal, c.path, c.text) for c in chunks] == [(0, "content.md", "c1"), (1, "content.md", "# h\nc2"), (2, "ocr/B.md", "o"), (3, "transcript/a.md", "t")]
    with pytest.raises(ValueError):
        markup.markdown_chunks(files, size=5, overlap=5)


def test_html(spark):
    html = '<h1>T &amp; x</h1><p>a  b<br>c</p><ol><li>one</li><li>two</li></ol><ul><li>dot</li></ul><pre>\n x\n  y\n</pre><p><a href="https://link.zhihu.com/?target=https%3A//e.org/p">site</a> <a href="https://e.org">https://e.org</a><a href="/rel">rel</a></p><img src="data:1"><img data-actualsrc="https://i/1" src="https://i/2"><img src="https://i/1">'
    text, images = markup.html_text(html)
    assert text == "T & x\n\na b\nc\n\n1. one\n2. two\n- dot\n\n```\n x\n  y\n```\n\nsite (https://e.org/p) https://e.orgrel" and images == ["https://i/1"]
    r = spark.createDataFrame([(html,), (None,)], "h string").select(markup.render_html(F.col("h")).alias("r")).collect()
    assert (r[0].r.text, r[0].r.images, r[1].r.text, r[1].r.images) == (text, images, "", [])


def canonical(d, **kw):
    return hashlib.sha256(json.dumps(d, ensure_ascii=False, sort_keys=True, **kw).encode()).hexdigest()


def test_hashes(spark):
    t = datetime(2024, 1, 2, 3, 4, 5, 60, tzinfo=UTC)
    row = ("x", "i\"1", "https://e.org/é", 'ti\t"tle"\\', None, t, t.replace(microsecond=0), "line\n检 ", ["b", "a"], "v1")
    names = "platform source_id canonical_url title author published_at observed_at body collections extractor_version".split()
    df = spark.createDataFrame([row], "platform string, source_id string, canonical_url string, title string, author string, published_at timestamp, observed_at timestamp, body string, collections array<string>, extractor_version string")
    d = dict(zip(names, row)) | {"published_at": "2024-01-02T03:04:05.000060Z", "observed_at": "2024-01-02T03:04:05Z"}
    scans = F.create_map(F.lit("s2"), F.array(F.lit("b"), F.lit("a")), F.lit("s1"), F.array(F.lit("c")))
    one = F.array(hashes.batch_item())
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(x).alias("text")) for p, x in (("content.md", "é"), ("ocr/1.md", ""))])
    got = df.select(hashes.content_hash(), hashes.batch_fingerprint(one), hashes.batch_fingerprint(one, scans), hashes.fingerprint(files), hashes.tagged_hash("embed-v1", F.lit("p"), F.lit("h")), hashes.iso_micros(F.col("observed_at"))).first()
    kept = {k: d[k] for k in ("author", "body", "canonical_url", "platform", "published_at", "source_id", "title")}
    raw = b"".join(len(x).to_bytes(8, "big") + x for p, x in (("content.md", "é"), ("ocr/1.md", "")) for x in (p.encode(), x.encode()))
    compact = {"separators": (",", ":")}
    assert list(got) == [canonical(kept), canonical([d], **compact), canonical({"items": [d], "scope_scans": {"s1": ["c"], "s2": ["a", "b"]}}, **compact), hashlib.sha256(raw).hexdigest(), hashlib.sha256(b"embed-v1\0p\0h").hexdigest(), "2024-01-02T03:04:05.000000Z"]
    md = df.select(mapping.markdown(), mapping.markdown(True)) if "summary" in df.columns else df.withColumn("summary", F.lit("s ")).withColumn("tags", F.array(F.lit("a"), F.lit("b"))).select(mapping.markdown().alias("p"), mapping.markdown(True).alias("e")).first()
    assert md.p.startswith('---\nplatform: "x"\nsource_id: "i\\"1"\n') and 'author: "unknown"\n' in md.p and 'collections: ["a", "b"]\n---\n\n# ' in md.p and md.e == md.p + "\n## 摘要\n\ns\n\n标签：a · b\n"


def test_fields(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    ids = {"ok-1": True, "a.b": True, "..": False, "a.": False, "con.txt": False, "a/b": False, "": False, "a\n": False}
    assert {k: one(fields.safe_id(F.lit(k))) for k in ids} == ids and one(fields.safe_path(F.lit("a/b.md"))) and not one(fields.safe_path(F.lit("a/../b")))
    urls = {"https://e.org/a?b#c": True, "http://u:p@e.org:80/": True, "https://[::1]:8/": True, "ftp://e.org": False, "https://": False, "https://e.org:99999": False, "https://e.org/a b": False, "https://e.org:x": False}
    assert {k: one(fields.http_url(F.lit(k))) for k in urls} == urls
    assert [one(fields.clock(F.lit(x))) for x in (59.9, 3600.0)] == ["00:59", "01:00:00"] and [one(fields.clock_ms(F.lit(x))) for x in (0.0005, 0.0015, 3599.9999)] == ["00:00:00.000", "00:00:00.002", "01:00:00.000"]
    assert one(fields.tags(F.array(*map(F.lit, (" A ", "a", "", "B"))))) == ["a", "b"] and one(fields.plain(F.lit("a\x00b\nc"), 2)) == "ab"
    assert [one(fields.utf8_head(F.lit("aé检😀"), n)) for n in (1, 2, 3, 5, 6, 9, 10)] == ["a", "a", "aé", "aé", "aé检", "aé检", "aé检😀"]
    assert one(fields.cjk_share(F.lit("检 a"))) == 0.5 and one(fields.language(F.lit("!"))) == "subtitle" and one(fields.duration(F.lit(3665))) == "1h01m"


def test_validate(spark):
    t = datetime(2024, 1, 1, tzinfo=UTC)
    schema = "platform string, source_id string, canonical_url string, title string, published_at timestamp, observed_at timestamp, extractor_version string, assets array<struct<relative_path:string,media_type:string,text:string,sha256:string>>"
    a = ("ocr/1.md", "text/markdown", "x", hashlib.sha256(b"x").hexdigest())
    rows = [("x", "1", "https://e.org", "t", t, t, "v", [a]), ("y", "..", "e.org", " ", None, t, "", [a, a, ("../x", "a/b", "x", "0")]), (None,) * 8]
    got = [r.errors for r in validate.items(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == [] and got[1] == ["platform", "source_id", "canonical_url", "published_at", "title", "extractor_version", "assets", "asset_paths"]
    assert got[2] == ["platform", "source_id", "canonical_url", "published_at", "observed_at", "title", "extractor_version"]
    e = "summary string, tags array<string>, content_type string, provider string, model string, input_hash string, generated_at string"
    got = [r.errors for r in validate.enrichments(spark.createDataFrame([("s", ["a"], "text", "p", "m", "h", "2024-01-01T00:00:00Z"), ("", ["a", "A"], "pdf", "p", "m", "h" * 201, "2024-01-01")], e)).collect()]
    assert got == [[], ["summary", "tags_unique", "content_type", "input_hash", "generated_at"]]
    lim = [r.errors for r in validate.scan_limits(spark.createDataFrame([("zhihu", ["1"], {"s": ["1"]}, ["1"]), ("x", ["1", "1"], {"s": ["1", "1"]}, ["1"])], "platform string, items array<string>, scopes map<string,array<string>>, frontier array<string>")).collect()]
    assert lim == [[], ["item_ids", "scope_ids", "flat"]]
    job = [r.errors for r in validate.jobs(spark.createDataFrame([(["x"], "full", t, t, 1, None), ([], "odd", t, datetime(2023, 1, 1, tzinfo=UTC), 0, ["s"])], "platforms array<string>, mode string, since timestamp, until timestamp, cap int, scopes array<string>")).collect()]
    assert job == [[], ["platforms", "mode", "range", "cap", "scopes"]]
    assert spark.range(1).select(validate.unknown_keys(F.lit('{"a":1,"b":2}'), ["a"]).alias("k")).first().k == ["b"]
