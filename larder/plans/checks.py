"""Queries over parsers, validation and fields, on records made of the given tables, and their SQL for DuckDB."""

from pyspark.sql import functions as F

from larder.functions import fields, hashes
from larder.functions.text import readable
from larder.operators import library, mapping, request, validate
from larder.plans.capture import OBSERVED, _pages, captured
from larder.plans.shared import ASKED, index_rows, stored_index
from larder.sources import pages
from larder.sources.binding import items, table

QUERIES_ASKED = (*ASKED, (4, "..."), (5, "zzqx"))
DAY = "2024-01-02T00:00:00+00:00"


def _id():
    return F.col("doc_id")


def _request():
    return request.Request(QUERIES_ASKED, platforms=("github", "x"), published_since=DAY)


def _answer(spark, sf):
    it = items(spark, sf).withColumn("published_at", F.timestamp_seconds("published")).withColumn("favorited_at", F.timestamp_seconds("favorited"))
    ok = request.let_in(_request(), it)
    chunks = index_rows(spark, sf).withColumn("path", F.when(F.col("ordinal") % 4 == 3, "../out.md").otherwise("content.md"))
    status = spark.createDataFrame([(0, 0)], "index_open int, embedding_open int")
    return request.answer(spark, _request(), stored_index(spark, sf), ok, request.safe_chunks(chunks), ok.select("doc_id", F.lit(1.0).alias("factor")), status)


def answered_search(spark, sf):
    """Hits of a request with filters, each with its excerpt; chunks with an unsafe path give way to the next."""
    hits = _answer(spark, sf)[0]
    return hits.select("query_id", "rank", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "citation", F.sha2("excerpt", 256).alias("excerpt"))


def answer_reasons(spark, sf):
    return _answer(spark, sf)[1]


def bilibili_bundles(spark, sf):
    """Favourites with details for half of them, some refused, and subtitles for a third, some of another video."""
    c, s = captured(spark, sf), lambda x, n: x.alias(n)
    media = F.struct(s(F.concat(F.lit("BV"), "source_id"), "bvid"), s(F.col("title"), "title"), s(F.lit("intro"), "intro"), s(F.unix_seconds("published_at"), "pubtime"), s(F.struct(s(F.col("author"), "name"), s(_id(), "mid")), "upper"))
    got = pages.bilibili_resources(_pages(c, media, lambda a: F.struct(s(F.lit(0), "code"), s(F.struct(s(a, "medias")), "data"))))
    seen = pages.exploded(got, "medias", "entry", "page").select(F.col("page").alias("seq"), "entry", F.col("entry.bvid").alias("bvid"), F.col("entry.fav_time").alias("fav"), F.lit("folder").alias("folder"))
    bvid = F.concat(F.lit("BV"), "source_id").alias("bvid")
    video = F.struct(s(F.concat(F.lit("BV"), "source_id"), "bvid"), s(F.concat(F.lit("detail "), "source_id"), "title"), s(F.lit("described"), "desc"), s(F.unix_seconds("published_at") + 1, "pubdate"), s(F.struct(s(F.lit("own"), "name")), "owner"), s(F.lit(61), "duration"))
    page = F.to_json(F.struct(s(F.when(_id() % 8 == 0, -404).otherwise(0), "code"), s(video, "data")))
    details = pages.bilibili_detail(c.where("doc_id % 2 = 0").select(bvid, page.alias("body"))).select("bvid", "code", "video")
    cue = lambda a, b, t: F.struct(s(F.lit(a), "from"), s(F.lit(b), "to"), s(t, "content"))
    body = F.to_json(F.struct(s(F.lit("zh-CN"), "lan"), s(F.when(_id() % 12 == 0, F.array(cue(0.0, 1.0, F.lit("x"))).cast("array<struct<from:double,to:double,content:string>>")).otherwise(F.array(cue(65.5, 70.0, F.lit("later")), cue(0.0, 1.0, F.col("title")), cue(0.0, 1.0, F.col("title")))), "body")))
    subs = pages.bilibili_subtitle(c.where("doc_id % 3 = 0").select(bvid, body.alias("body"), (_id() % 12 == 0).alias("other")))
    lost = lambda x: F.when(~F.col("other"), x)
    subs = subs.select("bvid", "code", lost(F.col("language")).alias("language"), lost(F.col("cues")).alias("cues"), F.lit(None).cast("string").alias("raw"), F.lit("player").alias("source"), F.when(F.col("other"), "cid=1").alias("offered"), F.when(F.col("other"), "cid=2").alias("asked"))
    out = mapping.bilibili(mapping.favourites(seen, "bvid", "folder", "fav", "seq", "entry"), details, subs, F.timestamp_seconds(F.lit(OBSERVED)))
    meta = lambda k: F.get_json_object("platform_metadata", f"$.{k}").alias(k)
    return out.select("source_id", "title", "author", "body", F.unix_seconds("published_at").alias("published"), meta("source_status"), meta("subtitle_status"), F.size("assets").cast("long").alias("assets"))


def zhihu_answers(spark, sf):
    """Answers by their question, articles by their own title, and pins by their excerpt."""
    c, s = captured(spark, sf), lambda x, n: x.alias(n)
    kind = F.element_at(F.array(F.lit("answer"), F.lit("article"), F.lit("pin")), (_id() % 3 + 1).cast("int"))
    html = F.concat(F.lit("<p>"), "title", F.lit(" &amp; more</p><ul><li>one</li><li>two</li></ul><img src=\"https://i/"), "source_id", F.lit('">'))
    content = F.struct(s(kind, "type"), s(_id(), "id"), s(F.col("canonical_url"), "url"), s(F.when(_id() % 3 == 1, F.col("title")), "title"), s(html, "content"), s(F.lit("said"), "excerpt"), s(F.struct(s(F.concat(F.lit("why "), "source_id"), "title"), s(_id() + 7, "id")), "question"), s(F.struct(s(F.col("author"), "name")), "author"), s(F.unix_seconds("published_at"), "created_time"), s(F.unix_seconds("published_at"), "updated_time"), s(F.unix_seconds("published_at"), "created"), s(F.unix_seconds("published_at"), "updated"))
    entry = F.struct(s(hashes.iso_utc(F.col("published_at")), "created"), s(content, "content"))
    got = pages.zhihu_items(_pages(c, entry, lambda a: F.struct(s(a, "data"), s(F.struct(s(F.lit(False), "is_end")), "paging"))))
    fav = pages.exploded(got, "favorites", "f", "is_end").select("is_end", "f.*", F.array(F.lit("c")).alias("collections"))
    out = mapping.zhihu(fav, F.timestamp_seconds(F.lit(OBSERVED)))
    return out.select("source_id", "title", "body", F.unix_seconds("published_at").alias("published"), F.get_json_object("platform_metadata", "$.question_id").alias("question"))


def page_codes(spark, sf):
    """The code that each parser gives for pages with errors of its platform, one of each kind for every event."""
    i = F.col("event_id")
    n = F.element_at(F.array(*map(F.lit, (0, -101, -404, -1, 0))), (i % 5 + 1).cast("int"))
    folder = F.format_string('{"code": %d, "data": {"list": [{"id": %d, "title": "t", "media_count": %s}]}}', n, i, F.when(i % 5 == 4, '"x"').otherwise("1"))
    detail = F.format_string('{"code": %d, "data": {"bvid": "B", "title": "t", "pubdate": %s}}', n, F.when(i % 5 == 4, "null").otherwise("5"))
    subtitle = F.format_string('{"body": [%s]}', F.when(i % 5 == 0, "").when(i % 5 == 1, '{"from": "x", "to": 1, "content": ""}').otherwise('{"from": 0, "to": 1, "content": "c"}'))
    starred = F.when(i % 3 == 0, '{"message": "API rate limit exceeded"}').when(i % 3 == 1, '{"message": "Not Found"}').otherwise("[]")
    out = table(spark, sf, "events").select("event_id")
    for name, parse, body in (("folders", pages.bilibili_folders, folder), ("detail", pages.bilibili_detail, detail), ("subtitle", pages.bilibili_subtitle, subtitle), ("starred", pages.github_starred, starred)):
        got = parse(table(spark, sf, "events").select("event_id", body.alias("body"))).select("event_id", F.col("code").alias(name))
        out = out.join(got, "event_id")
    return out


def id_collisions(spark, sf):
    """Ids that differ only in case, two documents to an id."""
    d = table(spark, sf, "documents").where("source is not null")
    names = F.concat(F.when(_id() % 4 == 3, F.lit("Item-")).otherwise("item-"), F.floor(_id() / 2).cast("string"))
    return library.id_collisions(d.select(names.alias("id")), "id")


def unchanged_snapshots(spark, sf):
    """Snapshots that need no write when every item is captured again, some with another text, folder or version."""
    c = captured(spark, sf)
    asset = F.array(F.struct(F.lit("ocr/1.md").alias("relative_path"), F.sha2("title", 256).alias("sha256")))
    side = lambda text, folders, version: F.struct(F.sha2(text, 256).alias("content_hash"), folders.alias("collections"), version.alias("extractor_version"), asset.alias("assets"))
    old = side(F.col("body"), F.array(F.lit("a"), F.lit("b")), F.lit("v1")).alias("old")
    new = side(F.when(_id() % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")), F.when(_id() % 5 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("b"))), F.when(_id() % 7 == 0, "v2").otherwise("v1")).alias("new")
    return c.select("doc_id", old, new).select("doc_id", mapping.unchanged().alias("unchanged"))


def request_errors(spark, sf):
    """Errors of scan arguments, job requests, enrichments and assets, made of every document with some bent."""
    d = table(spark, sf, "documents").select("doc_id")
    ids = lambda n: F.transform(F.sequence(F.lit(1), n), lambda x: x.cast("string"))
    some = F.array(F.lit("1"), F.lit("2"))
    scan = d.select("doc_id", F.when(_id() % 2 == 0, "zhihu").otherwise("x").alias("platform"), F.when(_id() % 5 == 0, ids(F.lit(51))).when(_id() % 5 == 1, F.array(F.lit("1"), F.lit("1"))).otherwise(some).alias("items"), F.create_map(F.lit("s"), F.when(_id() % 7 == 0, ids(F.lit(201))).otherwise(some)).alias("scopes"), F.when(_id() % 11 == 0, ids(F.lit(101))).otherwise(some).alias("frontier"))
    job = d.select("doc_id", F.when(_id() % 3 == 0, F.array().cast("array<string>")).when(_id() % 3 == 1, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("platforms"), F.when(_id() % 5 == 0, "some").otherwise("full").alias("mode"), F.timestamp_seconds(_id() % 4).alias("since"), F.timestamp_seconds(F.lit(2)).alias("until"), (_id() % 6).alias("cap"), F.lit(None).cast("array<string>").alias("scopes"))
    enriched = d.select("doc_id", F.when(_id() % 4 == 0, " ").otherwise("s").alias("summary"), F.when(_id() % 5 == 0, F.array(F.lit("A"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("tags"), F.when(_id() % 6 == 0, "other").otherwise("text").alias("content_type"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("h").alias("input_hash"), F.when(_id() % 7 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("generated_at"))
    one = F.struct(F.when(_id() % 2 == 0, "ocr/1.md").when(_id() % 3 == 0, "../x.md").otherwise("other/1.md").alias("relative_path"), F.lit("text/plain").alias("media_type"), F.lit("x").alias("text"), F.sha2(F.when(_id() % 5 == 0, "y").otherwise("x"), 256).alias("sha256"))
    asset = d.select("doc_id", validate.asset_errors(one).alias("errors"))
    text = lambda df, n: df.select("doc_id", F.array_join("errors", "|").alias(n))
    out = text(validate.scan_limits(scan), "scan")
    for df, n in ((validate.jobs(job), "job"), (validate.enrichments(enriched), "enrichment"), (asset, "asset")):
        out = out.join(text(df, n), "doc_id")
    keys = F.format_string('{"title": 1, "%s": 2}', F.when(_id() % 2 == 0, "body").otherwise("other"))
    return out.join(d.select("doc_id", F.array_join(validate.unknown_keys(keys, ["title", "body"]), "|").alias("unknown")), "doc_id")


def field_rules(spark, sf):
    """Renderings of single fields of every document."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    mixed = F.translate("text", "en", "检索")
    return d.select(
        "doc_id", fields.clock(_id() * 37).alias("clock"), fields.duration(_id() * 37).alias("duration"), fields.language(F.concat(F.lit("!zh_"), "source", F.lit("."))).alias("language"), fields.component(F.concat(F.lit(".a b/"), "source")).alias("component"),
        F.round(fields.cjk_share(mixed), 9).alias("cjk"), F.octet_length(fields.utf8_head(mixed, 100)).cast("long").alias("head"), fields.safe_id(F.when(_id() % 3 == 0, F.lit("con.md")).when(_id() % 3 == 1, F.lit("a.md")).otherwise(F.lit("a."))).alias("safe"),
        readable(F.col("text")).alias("readable"), F.array_join(fields.tags(F.split("source", "[^A-Za-z]+")), "|").alias("tags"),
    )


QUERIES = {f.__name__: f for f in (answered_search, answer_reasons, bilibili_bundles, zhihu_answers, page_codes, id_collisions, unchanged_snapshots, request_errors, field_rules)}


def sql(i: str, bm: str, lex) -> dict[str, str]:
    """SQL of the queries, from the common table expressions of items, scores and ranks."""
    tok = lambda c: rf"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    joined = lambda *cases: "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in cases) + ")"
    return {
        "answered_search": rf"""WITH {bm}, {i}, {lex("access_status = 'available' AND platform IN ('github', 'x') AND published >= 1704153600")},
          b AS (SELECT query_id, doc_id, any_value(platform) AS platform, min(rank) AS rank, min_by(ordinal, rank) AS ordinal FROM lex WHERE ordinal % 4 <> 3 AND rank <= 500 GROUP BY query_id, doc_id),
          h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM b),
          w AS (SELECT h.*, list_filter(regexp_split_to_array(text, '[\s\pZ]+'), lambda x: x <> '') AS w, (SELECT list(term) FROM q WHERE q.query_id = h.query_id) AS terms FROM h JOIN ch USING (doc_id, ordinal) WHERE place <= 10),
          a AS (SELECT *, greatest(1, coalesce(list_position(list_transform(w, lambda x: list_has_any({tok("x")}, terms)), true), 1) - 4) AS begin FROM w)
          SELECT query_id, place AS rank, doc_id, ordinal, 'item:' || platform || '/' || doc_id || '#chunk-' || ordinal AS citation,
            sha256(CASE WHEN begin > 1 THEN '…' ELSE '' END || array_to_string(w[begin:begin + 23], ' ') || CASE WHEN len(w) >= begin + 24 THEN '…' ELSE '' END) AS excerpt FROM a""",
        "answer_reasons": f"""WITH {bm}, {i}, {lex("access_status = 'available' AND platform IN ('github', 'x') AND published >= 1704153600")}, n AS (SELECT DISTINCT query_id FROM lex WHERE ordinal % 4 <> 3 AND rank <= 500)
          SELECT CAST(k AS INTEGER) AS query_id, query_id IS NOT NULL AS ok, CASE WHEN query_id IS NULL THEN 'no matching content; embedding_unavailable' END AS reason FROM range(1, 6) r(k) LEFT JOIN n ON query_id = k""",
        "bilibili_bundles": f"""WITH {i}, c AS (SELECT doc_id, source, published, doc_id % 2 = 0 AND doc_id % 8 <> 0 AS d, doc_id % 3 = 0 AND doc_id % 12 <> 0 AS s FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL)
          SELECT 'BV' || doc_id AS source_id, CASE WHEN d THEN 'detail ' ELSE 'item ' END || doc_id AS title, CASE WHEN d THEN 'own' ELSE source END AS author,
            CASE WHEN d THEN 'described' ELSE 'intro' END || CASE WHEN s THEN chr(10) || chr(10) || '## 字幕（zh-CN）' || chr(10) || '[00:00] item ' || doc_id || chr(10) || '[01:05] later' ELSE '' END AS body,
            CASE WHEN d THEN published + 1 ELSE published END AS published, CASE WHEN d THEN 'available' ELSE 'source_unavailable' END AS source_status,
            CASE WHEN s THEN 'available' WHEN doc_id % 3 = 0 THEN 'wrong_video' ELSE 'unavailable' END AS subtitle_status, CAST(CASE WHEN s THEN 1 ELSE 0 END AS BIGINT) AS assets FROM c""",
        "zhihu_answers": f"""WITH {i}, c AS (SELECT doc_id, published FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL)
          SELECT CASE doc_id % 3 WHEN 0 THEN 'answer-' WHEN 1 THEN 'article-' ELSE 'pin-' END || doc_id AS source_id, CASE doc_id % 3 WHEN 0 THEN 'why ' || doc_id WHEN 1 THEN 'item ' || doc_id ELSE 'pin ' || doc_id END AS title,
            CASE WHEN doc_id % 3 = 2 THEN 'said' ELSE 'item ' || doc_id || ' & more' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '## 图片' || chr(10) || chr(10) || '- https://i/' || doc_id END AS body,
            CASE WHEN doc_id % 3 = 2 THEN CAST({OBSERVED} AS BIGINT) ELSE published END AS published, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 7 AS VARCHAR) END AS question FROM c""",
        "page_codes": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'login_required' WHEN 0 THEN NULL ELSE 'page_changed' END AS folders, CASE event_id % 5 WHEN 1 THEN 'login_required' WHEN 2 THEN 'source_unavailable' WHEN 0 THEN NULL ELSE 'page_changed' END AS detail,
          CASE event_id % 5 WHEN 0 THEN 'subtitle_unavailable' WHEN 1 THEN 'malformed_subtitle' END AS subtitle, CASE event_id % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'source_unavailable' END AS starred FROM events""",
        "id_collisions": "SELECT 'item-' || doc_id // 2 AS folded, count(DISTINCT doc_id % 4 = 3) AS variants FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING variants > 1",
        "unchanged_snapshots": "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS unchanged FROM documents WHERE text IS NOT NULL",
        "request_errors": f"""SELECT doc_id, {joined(("doc_id % 5 = 0", "items"), ("doc_id % 5 = 1", "item_ids"), ("doc_id % 11 = 0", "frontier"), ("doc_id % 7 = 0", "scope_ids"), ("doc_id % 2 <> 0", "flat"))} AS scan,
          {joined(("doc_id % 3 <> 2", "platforms"), ("doc_id % 5 = 0", "mode"), ("doc_id % 4 = 3", "range"), ("doc_id % 6 = 0", "cap"))} AS job,
          {joined(("doc_id % 4 = 0", "summary"), ("doc_id % 5 = 0", "tags_unique"), ("doc_id % 6 = 0", "content_type"), ("doc_id % 7 = 0", "generated_at"))} AS enrichment,
          {joined(("doc_id % 2 <> 0 AND doc_id % 3 = 0", "path"), ("doc_id % 2 <> 0", "root"), ("doc_id % 5 = 0", "sha256"))} AS asset, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'other' END AS unknown FROM documents""",
        "field_rules": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, doc_id * 37 AS t FROM documents), m AS (SELECT *, translate(text, 'en', '检索') AS m, regexp_replace(translate(text, 'en', '检索'), '[\s\pZ]', '', 'g') AS solid FROM d),
          h AS (SELECT *, list_max(list_prepend(0, list_filter(list_transform(range(1, 101), lambda k: octet_length(encode(substring(m, 1, k)))), lambda n: n <= 100))) AS head,
            list_filter(list_transform(regexp_split_to_array(source, '[^A-Za-z]+'), lambda x: lower(x)), lambda x: x <> '') AS tg FROM m)
          SELECT doc_id, CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%02d:%02d', t // 60, t % 60) END AS clock,
            CASE WHEN t < 60 THEN printf('%ds', t) WHEN t < 3600 THEN printf('%dm%02ds', t // 60, t % 60) ELSE printf('%dh%02dm', t // 3600, t // 60 % 60) END AS duration,
            coalesce(nullif(regexp_replace(regexp_replace('!zh_' || source || '.', '[^A-Za-z0-9._-]', '', 'g'), '^\.+|\.+$', '', 'g'), ''), 'subtitle') AS language,
            coalesce(nullif(regexp_replace(regexp_replace('.a b/' || source, '[^A-Za-z0-9._-]', '-', 'g'), '^\.+|\.+$', '', 'g'), ''), 'unknown') AS component,
            round(CASE WHEN solid = '' THEN 0 ELSE CAST(length(regexp_replace(solid, '[^检索]', '', 'g')) AS DOUBLE) / length(solid) END, 9) AS cjk, CAST(head AS BIGINT) AS head, doc_id % 3 = 1 AS safe,
            length(trim(regexp_replace(text, 'https?://[^ \t-\r]+', '', 'g'))) AS readable, array_to_string(list_filter(tg, lambda x, k: list_position(tg, x) = k)[1:8], '|') AS tags FROM h""",
    }
