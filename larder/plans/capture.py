"""Queries over capture, ingest and maintenance, on items made of the given tables, and their SQL for DuckDB."""

from pyspark.sql import functions as F

from larder.functions import fields, hashes, markup
from larder.operators import ingest, maintenance, mapping, validate
from larder.sources import pages
from larder.sources.binding import items, table

OBSERVED = 1714521600


def captured(spark, sf):
    """Captured items, one per document with a text."""
    it = items(spark, sf).where("body is not null")
    return it.select(
        "doc_id", "platform", "source_id", F.concat(F.lit("https://e.org/"), "source_id").alias("canonical_url"), F.concat(F.lit("item "), "source_id").alias("title"), "author", F.timestamp_seconds("published").alias("published_at"),
        F.timestamp_seconds(F.lit(OBSERVED)).alias("observed_at"), "body", F.array("author").alias("collections"), F.lit("v1").alias("extractor_version"),
    )


def content_hash(spark, sf):
    return captured(spark, sf).select("doc_id", hashes.content_hash().alias("digest"))


def batch_fingerprint(spark, sf):
    c = captured(spark, sf).select(F.floor(F.col("doc_id") / 20).alias("batch"), F.struct("doc_id", hashes.batch_item().alias("json")).alias("i"))
    c = c.groupBy("batch").agg(F.array_sort(F.collect_list("i")).alias("i"))  # 20 items at most
    return c.select("batch", hashes.batch_fingerprint(F.transform("i", lambda x: x["json"])).alias("digest"))


def index_fingerprint(spark, sf):
    file = lambda p, t: F.struct(F.lit(p).alias("path"), t.alias("text"))
    return captured(spark, sf).select("doc_id", hashes.fingerprint(F.array(file("content.md", F.col("body")), file("ocr/1.md", F.col("title")))).alias("digest"))


def embed_task_hash(spark, sf):
    return captured(spark, sf).select("doc_id", hashes.tagged_hash("embed-v1", F.lit("profile"), F.sha2("body", 256)).alias("digest"))


def item_markdown(spark, sf):
    return captured(spark, sf).select("doc_id", F.sha2(mapping.markdown(), 256).alias("digest"))


def _pages(rows, entry, wrap=lambda a: a, each: int = 20):
    """Pages of JSON with ``each`` entries in order of id."""
    p = rows.select(F.floor(F.col("doc_id") / each).alias("page"), F.struct("doc_id", entry.alias("e")).alias("i")).groupBy("page").agg(F.array_sort(F.collect_list("i")).alias("i"))
    return p.select("page", F.to_json(wrap(F.transform("i", lambda x: x["e"]))).alias("body"))


def _shown(df):
    return df.select("source_id", "canonical_url", "author", F.sha2("title", 256).alias("title"), F.sha2("body", 256).alias("body"), F.unix_seconds("published_at").alias("published"), F.get_json_object("platform_metadata", "$.favorited_at").alias("favorited"))


def github_items(spark, sf):
    c, s = captured(spark, sf), lambda x, n: x.alias(n)
    iso = hashes.iso_utc(F.col("published_at"))
    repo = F.struct(s(F.concat(F.lit("o/"), "source_id"), "full_name"), s(F.col("canonical_url"), "html_url"), s(F.lit("main"), "default_branch"), s(iso, "created_at"), s(F.col("body"), "description"), s(F.array("author"), "topics"))
    got = pages.github_starred(_pages(c, F.struct(s(iso, "starred_at"), s(repo, "repo"))))
    return _shown(mapping.github(pages.exploded(got, "stars", "s").select("s.*"), F.timestamp_seconds(F.lit(OBSERVED)), F.lit("read me")))


def x_items(spark, sf):
    c, s = captured(spark, sf), lambda x, n: x.alias(n)
    core = F.struct(s(F.struct(s(F.struct(s(F.struct(s(F.col("author"), "name"), s(F.lit("ann"), "screen_name")), "core")), "result")), "user_results"))
    legacy = F.struct(s(F.col("body"), "full_text"), s(F.date_format(F.to_utc_timestamp("published_at", F.current_timezone()), "'Mon' MMM dd HH:mm:ss '+0000' yyyy"), "created_at"))
    result = F.struct(s(F.lit("Tweet"), "__typename"), s(F.col("source_id"), "rest_id"), s(core, "core"), s(legacy, "legacy"))
    entry = F.struct(s(F.concat(F.lit("tweet-"), "source_id"), "entryId"), s(F.struct(s(F.lit("TimelineTimelineItem"), "entryType"), s(F.struct(s(F.struct(s(result, "result")), "tweet_results")), "itemContent")), "content"))
    add = lambda a: F.struct(s(F.lit("TimelineAddEntries"), "type"), s(a, "entries"))
    wrap = lambda a: F.struct(s(F.struct(s(F.struct(s(F.struct(s(F.array(add(a)), "instructions")), "timeline")), "bookmark_timeline_v2")), "data"))
    got = pages.exploded(pages.x_bookmarks(_pages(c, entry, wrap)), "tweets", "t").select("t.*")
    return _shown(mapping.x(got, F.timestamp_seconds(F.lit(OBSERVED))))


def bilibili_items(spark, sf):
    c, s = captured(spark, sf), lambda x, n: x.alias(n)
    media = F.struct(s(F.concat(F.lit("BV"), "source_id"), "bv_id"), s(F.col("title"), "title"), s(F.col("body"), "intro"), s(F.unix_seconds("published_at"), "pubtime"), s(F.unix_seconds("published_at") + 60, "fav_time"), s(F.struct(s(F.col("author"), "name"), s(F.col("doc_id"), "mid")), "upper"))
    got = pages.bilibili_resources(_pages(c, media, lambda a: F.struct(s(F.lit(0), "code"), s(F.struct(s(a, "medias")), "data"))))
    seen = pages.exploded(got, "medias", "entry", "page").select(F.col("page").alias("seq"), "entry", F.col("entry.bvid").alias("bvid"), F.col("entry.fav_time").alias("fav"), F.lit("folder").alias("folder"))
    obs = mapping.favourites(seen, "bvid", "folder", "fav", "seq", "entry")
    details = spark.createDataFrame([], "bvid string, code string, video struct<title:string,author:string,author_mid:string,description:string,cover_url:string,published_at:timestamp,duration:long>")
    subs = spark.createDataFrame([], "bvid string, code string, language string, cues array<struct<start:double,end:double,content:string>>, raw string, source string, offered string, asked string")
    return _shown(mapping.bilibili(obs, details, subs, F.timestamp_seconds(F.lit(OBSERVED))))


def zhihu_items(spark, sf):
    c, s = captured(spark, sf), lambda x, n: x.alias(n)
    content = F.struct(s(F.lit("pin"), "type"), s(F.col("doc_id"), "id"), s(F.col("canonical_url"), "url"), s(F.col("title"), "title"), s(F.col("body"), "excerpt"), s(F.struct(s(F.col("author"), "name")), "author"))
    entry = F.struct(s(hashes.iso_utc(F.col("published_at")), "created"), s(content, "content"))
    got = pages.zhihu_items(_pages(c, entry, lambda a: F.struct(s(a, "data"), s(F.struct(s(F.lit(True), "is_end")), "paging"))))
    fav = pages.exploded(got, "favorites", "f").select("f.*", F.array(F.lit("c")).alias("collections"))
    return _shown(mapping.zhihu(fav, F.timestamp_seconds(F.lit(OBSERVED))))


def page_text(spark, sf):
    """Readable text and images of every page (no SQL: an HTML parser)."""
    r = markup.render_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", r.alias("r")).select("page_id", F.sha2("r.text", 256).alias("digest"), F.size("r.images").alias("images"))


def markdown_chunks(spark, sf):
    """Chunks of every text with line ranges (no SQL: a line walk)."""
    c = markup.markdown_chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return c.select("doc_id", "ordinal", "line_start", "line_end", "heading", F.sha2("text", 256).alias("digest"))


def item_errors(spark, sf):
    i = F.col("doc_id")
    c = captured(spark, sf).withColumn("source_id", F.when(i % 5 == 0, F.concat("source_id", F.lit("."))).otherwise(F.col("source_id"))).withColumn("title", F.when(i % 7 == 0, " \t").otherwise(F.col("title")))
    c = c.withColumn("canonical_url", F.when(i % 11 == 0, F.concat(F.lit("ftp://"), "source_id")).otherwise(F.col("canonical_url"))).withColumn("platform", F.when(i % 13 == 0, "other").otherwise(F.col("platform")))
    return validate.items(c).select("doc_id", F.array_join("errors", "|").alias("errors"))


def batch_replay(spark, sf):
    """All items in batches of 50 a platform, full mode, one batch in nine known already, against a state of two thirds of them."""
    c = captured(spark, sf)
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    state = c.where("doc_id % 3 <> 0").select("platform", "source_id", hashes.content_hash().alias("content_hash"), "published_at", F.col("observed_at").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("favorited_at"), F.lit("available").alias("access_status"))
    rows = c.withColumn("body", changed).withColumn("job_id", F.lit("j")).withColumn("key", F.floor(F.col("doc_id") / 200).cast("string")).withColumn("pos", (F.col("doc_id") % 200).cast("int"))
    rows = rows.withColumn("source_status", F.lit("available")).withColumn("favorited_at", F.lit(None).cast("timestamp"))
    runs = spark.createDataFrame([("j", p, "running", "full", 0, None, None, None) for p in fields.PLATFORMS], "job_id string, platform string, status string, mode string, scanned long, cap long, since timestamp, until timestamp")
    receipts = ingest.batches(rows.where("cast(key as long) % 9 = 0"))
    got = ingest.submit(rows, receipts, runs, state)["receipts"]
    return got.select("platform", "key", "scanned", "added", "refreshed", "duplicates")


def frontier_union(spark, sf):
    """Per platform: the 20 newest ids of this scan before the ids of an older frontier, distinct, 20 in all."""
    it = items(spark, sf)
    newest = lambda rows, n: rows.groupBy("platform").agg(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("published", "doc_id")))), lambda x: x["doc_id"].cast("string")), 1, n).alias("ids"))
    runs = it.select(F.lit("j").alias("job_id"), "platform", F.lit("running").alias("status"), F.lit("incremental").alias("mode")).distinct()
    res = newest(it.where("doc_id % 2 = 0"), 12).select(F.lit("j").alias("job_id"), "platform", F.lit(True).alias("observed_end"), F.lit(False).alias("cap_reached"), "ids")
    _, f = ingest.finish(runs.withColumn("truncated", F.lit(False)), res, newest(it, 20))
    return f.select("platform", F.array_join("ids", "|").alias("ids"))


def maintenance_actions(spark, sf):
    it = items(spark, sf)
    known = it.where("doc_id % 5 <> 0").withColumn("access_status", F.when(F.col("doc_id") % 19 == 0, "missing").otherwise(F.col("access_status")))
    return maintenance.maintenance(it.where("doc_id % 4 <> 0"), known).select("platform", "source_id", "action")


def backfill_plan(spark, sf):
    it = items(spark, sf).withColumn("favorited_at", F.timestamp_seconds("favorited"))
    told = F.when(F.col("doc_id") % 3 == 0, "source_unavailable").when(F.col("doc_id") % 3 == 1, "login_required").otherwise("available")
    snaps = it.select("platform", "source_id", F.timestamp_seconds(F.col("published") + 86400).alias("favorited_at"), told.alias("source_status"))
    p = maintenance.backfill(it, snaps)
    return p.select("platform", "source_id", F.unix_seconds("favorited_at").alias("favorited"), "access_status", "changed")


def stale_indexes(spark, sf):
    it = items(spark, sf).select("platform", "source_id", "doc_id", "access_status", F.sha2(F.coalesce("body", F.lit("")), 256).alias("index_hash"))
    chunks = it.where("doc_id % 6 <> 0").select("platform", "source_id", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("index_hash")).alias("input_hash"))
    return maintenance.stale_indexes(it, chunks).select("platform", "source_id")


def task_settle(spark, sf):
    it = items(spark, sf)
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "completed"))), (F.col("doc_id") % 3 + 1).cast("int"))
    out = F.element_at(F.array(*map(F.lit, ("claim", "complete", "fail", "decline"))), (F.col("doc_id") % 4 + 1).cast("int"))
    t = it.select(F.col("source_id").alias("task_id"), status.alias("status"))
    return maintenance.settle(t, it.select(F.col("source_id").alias("task_id"), out.alias("outcome")))


def tag_rule(spark, sf):
    raw = F.slice(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 120), " "), 1, 12)
    return table(spark, sf, "documents").select("doc_id", F.array_join(fields.tags(raw, fold=F.lower), "|").alias("tags"))


def clock_ms(spark, sf):
    return table(spark, sf, "events").select("event_id", fields.clock_ms(F.col("value") * 100).alias("clock"))


def url_rule(spark, sf):
    u = F.when(F.col("page_id") % 5 == 0, F.replace(F.col("url"), F.lit("http"), F.lit("ftp"))).when(F.col("page_id") % 7 == 0, F.concat(F.col("url"), F.lit(" x"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", fields.http_url(u).alias("accepted"))


def plain_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(fields.plain(F.col("text")), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, batch_fingerprint, index_fingerprint, embed_task_hash, item_markdown, github_items, x_items, bilibili_items, zhihu_items, page_text, markdown_chunks, item_errors, batch_replay, frontier_union,
        maintenance_actions, backfill_plan, stale_indexes, task_settle, tag_rule, clock_ms, url_rule, plain_text,
    )
}


def sql(items_cte: str) -> dict[str, str]:
    """SQL of the queries, from the common table expression of the items."""
    cap = f"""WITH {items_cte}, c AS (SELECT doc_id, platform, CAST(doc_id AS VARCHAR) AS source_id, 'https://e.org/' || doc_id AS canonical_url, 'item ' || doc_id AS title, source AS author, published,
      strftime(make_timestamp(published * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, text AS body FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL)"""
    strip = r"regexp_replace(body, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"
    j = lambda c: f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
    full = f"""'{{"author": ' || {j("author")} || ', "body": ' || {j("body")} || ', "canonical_url": ' || {j("canonical_url")} || ', "platform": ' || {j("platform")} || ', "published_at": "' || iso || '", "source_id": ' || {j("source_id")} || ', "title": ' || {j("title")} || '}}'"""
    compact = f"""'{{"author":' || {j("author")} || ',"body":' || {j("body")} || ',"canonical_url":' || {j("canonical_url")} || ',"collections":[' || {j("author")} || '],"extractor_version":"v1","observed_at":"2024-05-01T00:00:00Z","platform":' || {j("platform")}
      || ',"published_at":"' || iso || '","source_id":' || {j("source_id")} || ',"title":' || {j("title")} || '}}'"""
    sized = lambda c: f"printf('%016X', octet_length(encode({c}))) || hex(encode({c}))"
    shown = lambda sid, url, title, body, fav="NULL", pub="published": f"{cap} SELECT {sid} AS source_id, {url} AS canonical_url, {{author}} AS author, sha256({title}) AS title, sha256({body}) AS body, {pub} AS published, {fav} AS favorited FROM c"
    author = lambda q, a="author": q.replace("{author}", a)
    first = r"substring(regexp_replace(regexp_extract(body, '[^ \t-\r][^\n]*', 0), '[ \t-\r]+\z', ''), 1, 80)"
    return {
        "content_hash": f"{cap} SELECT doc_id, sha256({full}) AS digest FROM c",
        "batch_fingerprint": f"{cap} SELECT doc_id // 20 AS batch, sha256('[' || string_agg({compact}, ',' ORDER BY doc_id) || ']') AS digest FROM c GROUP BY 1",
        "index_fingerprint": f"{cap} SELECT doc_id, sha256(unhex({sized(chr(39) + 'content.md' + chr(39))} || {sized('body')} || {sized(chr(39) + 'ocr/1.md' + chr(39))} || {sized('title')})) AS digest FROM c",
        "embed_task_hash": f"{cap} SELECT doc_id, sha256('embed-v1' || chr(0) || 'profile' || chr(0) || sha256(body)) AS digest FROM c",
        "item_markdown": rf"""{cap} SELECT doc_id, sha256('---' || chr(10) || 'platform: ' || {j("platform")} || chr(10) || 'source_id: ' || {j("source_id")} || chr(10) || 'canonical_url: ' || {j("canonical_url")} || chr(10) || 'author: '
          || {j("coalesce(nullif(author, ''), 'unknown')")} || chr(10) || 'published_at: "' || iso || '"' || chr(10) || 'collections: [' || {j("author")} || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
          || regexp_replace(body, '[ \t-\r]+\z', '') || chr(10)) AS digest FROM c""",
        "github_items": author(shown("'o__' || source_id", "canonical_url", "'o/' || source_id", f"concat_ws(chr(10) || chr(10), CASE WHEN {strip} <> '' THEN {strip} END, '主题：' || author, '## README' || chr(10) || chr(10) || 'read me')", "iso"), "'o'"),
        "x_items": author(shown("source_id", "'https://x.com/ann/status/' || source_id", f"coalesce(nullif({first}, ''), '推文 ' || source_id)", f"{strip}", "'2024-05-01T00:00:00Z'")),
        "bilibili_items": author(shown("'BV' || source_id", "'https://www.bilibili.com/video/BV' || source_id", "title", f"{strip}", "strftime(make_timestamp((published + 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ')")),
        "zhihu_items": author(shown("'pin-' || source_id", "canonical_url", "title", f"CASE WHEN {strip} <> '' THEN body ELSE '' END", "iso", f"CAST({OBSERVED} AS BIGINT)")),
        "item_errors": f"""{cap} SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 13 = 0 THEN 'platform' END, CASE WHEN doc_id % 5 = 0 THEN 'source_id' END, CASE WHEN doc_id % 11 = 0 THEN 'canonical_url' END, CASE WHEN doc_id % 7 = 0 THEN 'title' END) AS errors FROM c""",
        "batch_replay": f"""{cap} SELECT platform, CAST(doc_id // 200 AS VARCHAR) AS key, count(*) AS scanned, count(*) FILTER (WHERE doc_id % 3 = 0) AS added, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 7 = 0) AS refreshed,
          count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS duplicates FROM c WHERE doc_id // 200 % 9 <> 0 GROUP BY ALL""",
        "frontier_union": f"""WITH {items_cte}, a AS (SELECT platform, doc_id, row_number() OVER (PARTITION BY platform ORDER BY published DESC, doc_id DESC) AS n FROM items WHERE doc_id % 2 = 0),
          b AS (SELECT platform, doc_id, row_number() OVER (PARTITION BY platform ORDER BY published DESC, doc_id DESC) AS n FROM items),
          u AS (SELECT platform, doc_id, min(p) AS p FROM (SELECT platform, doc_id, n AS p FROM a WHERE n <= 12 UNION ALL SELECT platform, doc_id, 100 + n FROM b WHERE n <= 20 AND platform IN (SELECT platform FROM a)
            UNION ALL SELECT platform, doc_id, 100 + n FROM b WHERE n <= 20 AND platform NOT IN (SELECT platform FROM a)) GROUP BY ALL),
          r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY p) AS k FROM u) SELECT platform, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY k) AS ids FROM r WHERE k <= 20 GROUP BY platform""",
        "maintenance_actions": f"""WITH {items_cte}, k AS (SELECT doc_id, platform, doc_id % 4 <> 0 AS snap, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'missing' ELSE access_status END AS st FROM items)
          SELECT platform, CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN st IS NULL THEN 'register' WHEN st = 'unavailable' THEN 'keep' WHEN NOT snap THEN CASE WHEN st = 'missing' THEN 'keep' ELSE 'missing' END
            WHEN st = 'missing' THEN 'repair' ELSE 'keep' END AS action FROM k WHERE snap OR st IS NOT NULL""",
        "backfill_plan": f"""WITH {items_cte}, p AS (SELECT *, coalesce(least(favorited, published + 86400), published + 86400) AS f, CASE doc_id % 3 WHEN 0 THEN 'unavailable' WHEN 1 THEN access_status ELSE 'available' END AS s FROM items)
          SELECT platform, CAST(doc_id AS VARCHAR) AS source_id, f AS favorited, s AS access_status, f IS DISTINCT FROM favorited OR s <> access_status AS changed FROM p""",
        "stale_indexes": f"WITH {items_cte} SELECT platform, CAST(doc_id AS VARCHAR) AS source_id FROM items WHERE access_status = 'available' AND (doc_id % 6 = 0 OR doc_id % 10 = 0)",
        "task_settle": """SELECT CAST(doc_id AS VARCHAR) AS task_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'running' ELSE 'pending' END WHEN 2 THEN 'completed'
          ELSE CASE doc_id % 4 WHEN 1 THEN 'completed' WHEN 2 THEN 'pending' WHEN 3 THEN 'declined' ELSE 'running' END END AS status FROM documents""",
        "tag_rule": r"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(substring(coalesce(text, ''), 1, 120), ' ')[1:12], lambda t: lower(regexp_replace(t, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'))), lambda t: t <> '') AS t FROM documents),
          d AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:8] AS t FROM w) SELECT doc_id, array_to_string(t, '|') AS tags FROM d""",
        "clock_ms": """WITH s AS (SELECT event_id, CAST(round_even(value * 100 * 1000, 0) AS BIGINT) AS t FROM events)
          SELECT event_id, printf('%02d:%02d:%02d.%03d', t // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000) AS clock FROM s""",
        "url_rule": "SELECT page_id, page_id % 5 <> 0 AND page_id % 7 <> 0 AS accepted FROM pages",
        "plain_text": r"SELECT doc_id, sha256(substring(regexp_replace(text, '\p{Cc}', '', 'g'), 1, 200)) AS digest FROM documents",
    }
