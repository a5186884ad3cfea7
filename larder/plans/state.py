"""Queries over index, library and sync state, and their SQL for DuckDB."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.fields import clock
from larder.functions.text import readable, title, windows
from larder.operators import ingest, library, search, sync
from larder.plans.shared import events, fused, lexical, semantic
from larder.sources.binding import item_collections, items, table, tasks


def _n(name):
    return F.count("*").alias(name)


def index_status(spark, sf) -> DataFrame:
    i = items(spark, sf).agg(_n("items"), F.count_if(F.col("access_status") == "available").alias("available"))
    t = tasks(spark, sf).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "completed").alias("completed"))
    c = search.chunks(table(spark, sf, "documents").where("text is not null")).agg(_n("chunks"))
    # Three one-row totals side by side.
    return i.crossJoin(t).crossJoin(c).withColumn("state", F.when(F.col("pending") > 0, "pending").otherwise("ready"))


def embedding_status(spark, sf):
    e = table(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    e = e.select(F.col("vec_id").alias("doc_id"), F.coalesce(F.abs(norm - 1) <= 1e-5, F.lit(False)).alias("good"))
    got = table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left")
    got = got.agg(F.countDistinct("doc_id").alias("current"), F.countDistinct(F.when(F.col("good"), F.col("doc_id"))).alias("embedded"), F.count_if(~F.col("good")).alias("corrupt"))
    return got.withColumn("state", F.when(F.col("corrupt") > 0, "degraded").when(F.col("embedded") < F.col("current"), "partial").otherwise("ready"))


def task_histogram(spark, sf):
    return tasks(spark, sf).groupBy("kind", "status").agg(_n("n"))


def _filtered(spark, sf, ok):
    got = search.rank_lexical(lexical(spark, sf), items(spark, sf).join(ok, "doc_id", "left_semi"), 10)
    return got.select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score", "rank")


def lexical_filtered(spark, sf):
    return _filtered(spark, sf, search.allowed(items(spark, sf), tasks(spark, sf), platforms=["github", "x"], content_types=["text", "video"]))


def folder_filter(spark, sf):
    """Both arms honour the folder."""
    ok = search.allowed(items(spark, sf), filed=item_collections(spark, sf), folders=["quality"])
    return fused(spark, sf, 5, ok).select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score", "match_sources", "rank")


def bm25_phrase(spark, sf):
    return search.phrase(table(spark, sf, "documents"), "of the").select("doc_id")


def segment_collapse(spark, sf):
    return search.collapse_segments(semantic(spark, sf), F.floor(F.col("doc_id") / 2))


def evidence_levels(spark, sf):
    return library.evidence(items(spark, sf)).select("doc_id", "level", "factor")


def _grouped(spark, sf):
    ev = library.evidence(items(spark, sf)).where("access_status = 'available'")
    return search.group_hits(fused(spark, sf), ev)


def grouped_hits(spark, sf):
    return _grouped(spark, sf).select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "adjusted", "supporting", "rank")


def search_hybrid(spark, sf):
    it = items(spark, sf).select("doc_id", title(F.col("body")).alias("t"))
    cited = F.concat(F.lit("item:"), "platform", F.lit("/"), "source_id", F.lit("#chunk-"), F.col("ordinal").cast("string"))
    return _grouped(spark, sf).join(it, "doc_id").select("query_id", "rank", cited.alias("citation"), F.sha2("t", 256).alias("title_digest"))


def favorite_merge(spark, sf):
    i = items(spark, sf)
    again = i.where("doc_id % 2 = 0").select("doc_id", (F.col("published") + 432000).alias("favorited"))
    return library.merge_favorites(i, again, "doc_id", "favorited")


def missing_items(spark, sf):
    return library.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


def summarize_backfill(spark, sf):
    it = items(spark, sf).where("access_status = 'available'").select("doc_id", F.sha2("body", 256).alias("input_hash"))
    return library.missing(it.where("input_hash is not null"), tasks(spark, sf).where("status = 'completed'"), ["doc_id", "input_hash"])


def access_status(spark, sf):
    told = F.when(F.col("toxic") == 1, "source_unavailable").when(F.col("quality") == 1, "available").otherwise("login_required")
    return table(spark, sf, "labels").select("doc_id", ingest.access_status(told).alias("status"))


CHANGES = {"purchase": "added", "signup": "refreshed", "click": "refreshed", "view": "duplicate"}


def batch_counters(spark, sf):
    e = sync.number_batches(events(spark, sf), ["user_id"], ["at", "event_id"], 50)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv]), F.col("event_type"))
    got = sync.batch_counters(e.withColumn("change", kind), ["user_id"], "change", F.col("event_type") != "error")
    return got.withColumn("batch", F.col("batch").cast("long"))


def _runs(spark, sf):
    e = table(spark, sf, "events")
    rule = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "paused").when(F.col("event_type") == "view", "partial").otherwise("completed")
    return e.select("user_id", (F.col("event_id") % 2).alias("scope"), "event_id", rule.alias("status"))


def latest_run(spark, sf):
    return sync.latest(_runs(spark, sf), ["user_id", "scope"], ["event_id"], "status")


def job_rollup(spark, sf):
    return sync.job_rollup(latest_run(spark, sf), "user_id")


def task_claim(spark, sf):
    t = tasks(spark, sf).join(items(spark, sf).select("doc_id", "platform"), "doc_id")
    return sync.claim(t, ["platform"], ["created", "doc_id"], 3).select("platform", "doc_id", F.col("turn").cast("long").alias("turn"))


def summary_rule(spark, sf):
    """A summary of the first 120 characters: shorter than a body of 200 or more, and a readable body."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    ok = ((n < 200) | (F.length(F.substring("text", 1, 120)) < n)) & (readable(F.col("text")) >= 4)
    return d.select("doc_id", readable(F.col("text")).alias("readable"), ok.alias("accepted"))


def content_budget(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf, "conversations").withColumn("n", F.length("text").cast("long"))
    left = F.greatest(F.lit(0), 300 - F.coalesce(F.sum("n").over(w), F.lit(0)))
    return c.select("conv_id", "turn", "n", F.least("n", left).alias("kept"), (F.col("n") > left).alias("truncated"))


def clock_format(spark, sf):
    return table(spark, sf, "events").select("event_id", clock(F.col("event_id") * 37 % 20000).alias("clock"))


def title_rule(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(title(F.col("text")), 256).alias("title_digest"))


def url_check(spark, sf):
    part = lambda i: F.regexp_extract("url", r"^(https?)://([^/?#]+)", i)
    return table(spark, sf, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), (part(2) != "").alias("accepted"))


def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def id_collision(spark, sf):
    names = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    return library.id_collisions(table(spark, sf, "documents").select(names.alias("id")), "id")


def asset_diff(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return library.asset_diff(d.where("doc_id % 3 <> 0"), d.where("doc_id % 4 <> 0"), "doc_id")


def segment_truth(spark, sf):
    """Documents with chunks that have no segment, and how many."""
    c = search.chunks(table(spark, sf, "documents").where("text is not null")).select("doc_id", "ordinal")
    kept = c.where("(doc_id + ordinal) % 11 <> 0")
    return library.missing(c, kept, ["doc_id", "ordinal"]).groupBy("doc_id").agg(_n("missing"))


def answer_rubric(spark, sf):
    got = table(spark, sf, "labels").agg(F.round(F.avg(F.col("quality") * 5.0), 6).alias("mean_score"), F.round(F.sum("quality") * 100.0 / F.greatest(F.count("*"), F.lit(1)), 6).alias("coverage"), F.sum("toxic").cast("long").alias("hard_failures"))
    return got.withColumn("passed", (F.col("mean_score") >= 3.0) & (F.col("coverage") >= 90.0) & (F.col("hard_failures") == 0))


def token_windows(spark, sf):
    n = F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("int")
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", n.alias("n"))
    d = d.select("doc_id", "n", F.posexplode(windows(F.col("n"), 480, 32)).alias("ordinal", "begin"))
    return d.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("begin").cast("long").alias("begin"), F.least(F.col("n"), F.col("begin") + 480).cast("long").alias("finish"))


QUERIES = {
    f.__name__: f
    for f in (
        index_status, embedding_status, task_histogram, lexical_filtered, folder_filter, bm25_phrase, segment_collapse, evidence_levels,
        grouped_hits, search_hybrid, favorite_merge, missing_items, summarize_backfill, access_status, batch_counters, latest_run,
        job_rollup, task_claim, summary_rule, content_budget, clock_format, title_rule, url_check, json_props, id_collision, asset_diff,
        segment_truth, answer_rubric, token_windows,
    )
}


def sql(cte) -> dict[str, str]:
    """SQL of the queries, from the common table expressions of the binding."""
    i, filed, bm, lex, both, ch, ev = cte
    body = r"regexp_matches(coalesce(text, ''), '[^ \t-\r]')"
    title_of = r"substring(regexp_replace(regexp_extract(coalesce(text, ''), '[^ \t-\r][^\n]*', 0), '[ \t-\r]+\z', ''), 1, 80)"
    task = "tk AS (SELECT doc_id, 'index_content' AS kind, sha256(text) AS input_hash, CASE WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'completed' END AS status, 1704067200 + (doc_id * 37 % 5000) * 60 AS created FROM documents)"
    content = "ct AS (SELECT doc_id, ['text', 'video', 'mixed'][doc_id % 3 + 1] AS content_type, text FROM documents)"
    level = f"""ev AS (SELECT doc_id, CASE WHEN {body} AND content_type <> 'text' THEN 'mixed' WHEN {body} THEN 'body' WHEN content_type = 'video' THEN 'transcript'
      WHEN content_type = 'mixed' THEN 'ocr' ELSE 'title_only' END AS level FROM ct),
      fac AS (SELECT doc_id, level, CASE level WHEN 'title_only' THEN 0.75e0 WHEN 'body' THEN 0.95e0 ELSE 1e0 END AS factor FROM ev)"""
    groups = f"""{both()}, {content}, {level},
      c AS (SELECT f.*, factor, row_number() OVER (PARTITION BY query_id, f.doc_id ORDER BY f.rank) AS n FROM f JOIN fac USING (doc_id) WHERE access_status = 'available'),
      g AS (SELECT query_id, doc_id, platform, max(ordinal) FILTER (WHERE n = 1) AS ordinal, max(best_rank) FILTER (WHERE n = 1) AS best,
        max(score) FILTER (WHERE n = 1) * max(factor) AS adjusted, coalesce(string_agg(CAST(ordinal AS VARCHAR), '|' ORDER BY n) FILTER (WHERE n > 1), '') AS supporting FROM c WHERE n <= 4 GROUP BY query_id, doc_id, platform),
      h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, best, platform, CAST(doc_id AS VARCHAR), ordinal) AS INTEGER) AS rank FROM g)"""
    runs = """r AS (SELECT user_id, event_id % 2 AS scope, max_by(CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'paused' WHEN 'view' THEN 'partial' ELSE 'completed' END, event_id) AS status
      FROM events GROUP BY ALL)"""
    return {
        "index_status": f"""WITH {i}, {task}, {ch} SELECT *, CASE WHEN pending > 0 THEN 'pending' ELSE 'ready' END AS state FROM
          (SELECT count(*) AS items, count_if(access_status = 'available')::BIGINT AS available FROM items),
          (SELECT count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'completed')::BIGINT AS completed FROM tk), (SELECT count(*) AS chunks FROM ch)""",
        "embedding_status": """WITH e AS (SELECT vec_id, coalesce(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-5, false) AS good FROM embeddings),
          a AS (SELECT count(DISTINCT doc_id) AS current, count(DISTINCT doc_id) FILTER (WHERE good) AS embedded, count(*) FILTER (WHERE NOT good) AS corrupt FROM documents LEFT JOIN e ON doc_id = vec_id)
          SELECT *, CASE WHEN corrupt > 0 THEN 'degraded' WHEN embedded < current THEN 'partial' ELSE 'ready' END AS state FROM a""",
        "task_histogram": f"WITH {task} SELECT kind, status, count(*) AS n FROM tk GROUP BY ALL",
        "lexical_filtered": f"""WITH {bm}, {i}, {task}, {content}, {lex("doc_id IN (SELECT doc_id FROM items JOIN ct USING (doc_id) JOIN tk USING (doc_id) WHERE access_status = 'available' AND platform IN ('github', 'x') AND content_type IN ('text', 'video') AND status = 'completed')")}
          SELECT query_id, doc_id, ordinal, score, rank FROM lex WHERE rank <= 10""",
        "folder_filter": f"""WITH {filed}, {both("items.access_status = 'available' AND items.doc_id IN (SELECT doc_id FROM filed WHERE name = 'quality')", 50)} SELECT query_id, doc_id, ordinal, score, match_sources, rank FROM f""",
        "bm25_phrase": r"""SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ', ' of the ')""",
        "segment_collapse": f"WITH {both()} SELECT query_id, doc_id // 2 AS doc_id, max(score) AS score, first(doc_id ORDER BY score DESC, doc_id) AS segment FROM near WHERE near <= 500 GROUP BY query_id, doc_id // 2",
        "evidence_levels": f"WITH {content}, {level} SELECT doc_id, level, factor FROM fac",
        "grouped_hits": f"WITH {groups} SELECT query_id, doc_id, ordinal, adjusted, supporting, rank FROM h WHERE rank <= 10",
        "search_hybrid": f"""WITH {groups} SELECT query_id, rank, 'item:' || platform || '/' || h.doc_id || '#chunk-' || ordinal AS citation, sha256({title_of}) AS title_digest
          FROM h JOIN documents d ON d.doc_id = h.doc_id WHERE rank <= 10""",
        "favorite_merge": f"WITH {i} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN least(favorited, published + 432000) ELSE favorited END AS favorited FROM items",
        "missing_items": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "summarize_backfill": f"WITH {i}, {task} SELECT doc_id, input_hash FROM items JOIN tk USING (doc_id) WHERE access_status = 'available' AND status = 'pending' AND input_hash IS NOT NULL",
        "access_status": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'unavailable' WHEN quality = 1 THEN 'available' END AS status FROM labels",
        "batch_counters": f"""WITH {ev}, p AS (SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1) // 20 AS batch FROM ev),
          c AS (SELECT user_id, batch, count(*) AS scanned, count(*) FILTER (WHERE event_type = 'purchase') AS added, count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS refreshed,
            count(*) FILTER (WHERE event_type = 'view') AS duplicate, count(*) FILTER (WHERE event_type = 'error') AS out_of_range FROM p GROUP BY ALL)
          SELECT *, CAST(sum(scanned) OVER (PARTITION BY user_id ORDER BY batch) AS BIGINT) AS scanned_so_far FROM c""",
        "latest_run": f"WITH {runs} SELECT user_id, scope, status FROM r",
        "job_rollup": f"""WITH {runs} SELECT user_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'paused') THEN 'paused'
          WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'completed' END AS status FROM r GROUP BY user_id""",
        "task_claim": f"""WITH {i}, {task}, t AS (SELECT platform, doc_id, row_number() OVER (PARTITION BY platform ORDER BY created, doc_id) AS turn FROM tk JOIN items USING (doc_id) WHERE status = 'pending')
          SELECT platform, doc_id, turn FROM t WHERE turn <= 3""",
        "summary_rule": r"""WITH r AS (SELECT doc_id, length(coalesce(text, '')) AS n, length(trim(regexp_replace(coalesce(text, ''), 'https?://[^ \t-\r]+', '', 'g'))) AS readable FROM documents)
          SELECT doc_id, readable, (n < 200 OR least(n, 120) < n) AND readable >= 4 AS accepted FROM r""",
        "content_budget": """WITH w AS (SELECT conv_id, turn, length(text) AS n, greatest(0, 300 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM conversations) SELECT conv_id, turn, n, CAST(least(n, room) AS BIGINT) AS kept, n > room AS truncated FROM w""",
        "clock_format": """WITH s AS (SELECT event_id, event_id * 37 % 20000 AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60)
          ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock FROM s""",
        "title_rule": f"SELECT doc_id, sha256({title_of}) AS title_digest FROM documents",
        "url_check": "WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host FROM pages) SELECT *, host <> '' AS accepted FROM u",
        "json_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "id_collision": "SELECT lower(source) AS folded, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END) AS variants FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING variants > 1",
        "asset_diff": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'kept' END AS change FROM documents WHERE doc_id % 12 <> 0",
        "segment_truth": f"WITH {ch} SELECT doc_id, count(*) AS missing FROM ch WHERE (doc_id + ordinal) % 11 = 0 GROUP BY doc_id",
        "answer_rubric": """WITH a AS (SELECT round(avg(quality * 5e0), 6) AS mean_score, round(sum(quality) * 100e0 / greatest(count(*), 1), 6) AS coverage, CAST(sum(toxic) AS BIGINT) AS hard_failures FROM labels)
          SELECT *, mean_score >= 3 AND coverage >= 90 AND hard_failures = 0 AS passed FROM a""",
        "token_windows": r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t-\r]+')) AS n FROM documents WHERE text IS NOT NULL),
          w AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - 480) / 448.0) AS BIGINT)) + 1)) AS ordinal FROM n)
          SELECT doc_id, ordinal, ordinal * 448 AS begin, CAST(least(n, ordinal * 448 + 480) AS BIGINT) AS finish FROM w""",
    }
