"""Queries over imports, summaries and repairs, and their SQL for DuckDB."""

from pyspark.sql import functions as F

from larder.functions import fields, hashes
from larder.operators import drivers, library, maintenance, mapping
from larder.plans.capture import captured
from larder.sources.binding import items, table

CAP = 30


def _import(spark, sf):
    c = captured(spark, sf).withColumn("source_status", F.lit("available")).withColumn("favorited_at", F.lit(None).cast("timestamp")).withColumn("seq", -F.col("doc_id"))
    old = c.where("doc_id % 40 in (0, 2, 3) and platform <> 'github'").groupBy("platform").agg(F.collect_list("source_id").alias("ids"))
    state = c.where("doc_id % 3 = 0").select("platform", "source_id", hashes.content_hash().alias("content_hash"), "published_at", F.col("observed_at").alias("first_seen_at"), "favorited_at", F.lit("available").alias("access_status"))
    none = c.select(F.lit("").alias("job_id"), "platform", F.lit("").alias("key"), F.lit("").alias("fingerprint")).limit(0)
    return drivers.import_scan(c.drop("doc_id"), old, state, none, "j", cap=CAP)


def import_receipts(spark, sf):
    """All items as newest-first scans by platform, up to the first known id or the cap: counts of each batch."""
    return _import(spark, sf)["receipts"].select("platform", "key", "scanned", "added", "refreshed", "duplicates", "truncated")


def import_runs(spark, sf):
    """How the runs ended, and where their frontiers stand."""
    got = _import(spark, sf)
    f = got["frontiers"].select("platform", F.get("ids", F.lit(0)).alias("first"), F.size("ids").cast("long").alias("n"))
    return got["runs"].select("platform", "status").join(f, "platform", "left")


def content_rules(spark, sf):
    """Whether a summary and tags of every text would be taken; two letters are written as ideographs in some."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    body = F.when(i % 5 == 0, F.concat(F.lit("https://e.org/a b\n## 图片\n\n- "), "text")).when(i % 5 == 1, F.translate("text", "entiasourl", "检索检索检索检索检索")).otherwise(F.col("text"))
    tag = F.array(F.when(i % 2 == 0, "检").otherwise("jian"))
    d = d.select("doc_id", body.alias("body"), F.when(i % 3 == 0, F.concat(body, F.lit("!"))).otherwise(F.lit("short")).alias("summary"), tag.alias("tags"))
    return d.select("doc_id", fields.summary_fault(F.col("body"), F.col("summary")).alias("summary"), fields.tags_fault(F.col("body"), F.col("tags")).alias("tags"))


def folded_tags(spark, sf):
    """Tags without case: sharp s, sigmas and ligatures of every source name."""
    raw = F.array(F.concat(F.lit("Straße "), "source"), F.concat(F.lit("STRASSE "), "source"), F.lit("ΣΊΣΥΦΟΣ"), F.lit("σίσυφος"), F.lit("ﬁle"), F.lit("FILE"))
    return table(spark, sf, "documents").where("source is not null").select("doc_id", F.array_join(fields.tags(raw), "|").alias("tags"))


def evidence_assets(spark, sf):
    """Evidence of every item from its body and captured files."""
    i = F.col("doc_id")
    paths = F.array_compact(F.array(F.when(i % 2 == 0, "transcript/a.md"), F.when(i % 3 == 0, "ocr/1.md"), F.when(i % 5 == 0, "ocr/../../x.md"), F.lit("assets/raw.json")))
    e = library.evidence_of(F.when(i % 7 == 0, " \n").otherwise(F.col("text")), paths)
    return table(spark, sf, "documents").select("doc_id", e.alias("e")).select("doc_id", "e.level", F.array_join("e.sources", "|").alias("sources"), "e.factor")


def index_overview(spark, sf):
    """Counts of a library in which some items are not available, some tasks wait after a failure, and some chunks are of older texts."""
    i = F.col("doc_id")
    it = items(spark, sf).select("doc_id", "platform", "source_id", "access_status", F.sha2(F.coalesce("body", F.lit("")), 256).alias("index_hash"))
    chunks = it.where("doc_id % 4 <> 0").select("platform", "source_id", F.when(i % 6 == 0, "old").otherwise(F.col("index_hash")).alias("input_hash"))
    tasks = it.select("platform", "source_id", F.lit("index_content").alias("kind"), F.col("index_hash").alias("input_hash"), F.when(i % 7 == 0, "pending").when(i % 11 == 0, "running").otherwise("completed").alias("status"), F.when(i % 14 == 0, "lost").alias("error"))
    return library.index_summary(it, chunks, tasks, True)


def reconciled_tasks(spark, sf):
    """Embedding tasks after their items' windows were checked against those stored."""
    i = F.col("doc_id")
    it = items(spark, sf).select("doc_id", "platform", "source_id")
    seg = it.select("platform", "source_id", F.col("source_id").alias("chunk_id"), F.lit(0).alias("begin"), F.lit(9).alias("finish"), "doc_id")
    stored = seg.where("doc_id % 5 <> 0").withColumn("finish", F.when(i % 7 == 0, 8).otherwise(9))
    tasks = it.select("platform", "source_id", F.lit("embed").alias("kind"), F.when(i % 3 == 0, "running").otherwise("completed").alias("status"))
    return maintenance.reconcile(tasks, maintenance.segment_faults(seg, stored), seg).select("platform", "source_id", "status")


def page_repairs(spark, sf):
    """Pages to write again after the stored ones were compared with what items render to."""
    i = F.col("doc_id")
    c = captured(spark, sf).select("doc_id", "platform", "source_id", mapping.markdown().alias("text"))
    stored = c.where("doc_id % 4 <> 0").withColumn("text", F.when(i % 6 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    got = library.content_repairs(c.drop("doc_id"), stored)
    return got.select("platform", "source_id", F.sha2("text", 256).alias("digest"), "reason")


QUERIES = {f.__name__: f for f in (import_receipts, import_runs, content_rules, folded_tags, evidence_assets, index_overview, reconciled_tasks, page_repairs)}


def sql(i: str, item_markdown: str) -> dict[str, str]:
    """SQL of the queries, from the common table expression of the items and the query of their pages."""
    sid = "CAST(doc_id AS VARCHAR)"
    scan = f"""{i}, c AS (SELECT doc_id, platform, row_number() OVER (PARTITION BY platform ORDER BY doc_id DESC) - 1 AS pos, platform <> 'github' AND doc_id % 40 IN (0, 2, 3) AS known FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL),
      s AS (SELECT *, min(pos) FILTER (WHERE known) OVER (PARTITION BY platform) AS stop FROM c), k AS (SELECT * FROM s WHERE stop IS NULL OR pos <= stop)"""
    return {
        "import_receipts": f"""WITH {scan} SELECT platform, CAST(pos // 20 AS VARCHAR) AS key, count(*) FILTER (WHERE pos < {CAP}) AS scanned, count(*) FILTER (WHERE pos < {CAP} AND doc_id % 3 <> 0) AS added, CAST(0 AS BIGINT) AS refreshed,
          count(*) FILTER (WHERE pos < {CAP} AND doc_id % 3 = 0) AS duplicates, bool_or(pos >= {CAP}) AS truncated FROM k GROUP BY platform, pos // 20""",
        "import_runs": f"""WITH {scan}, r AS (SELECT platform, bool_or(pos >= {CAP}) AS capped, max(doc_id) AS newest, count(*) AS n FROM k GROUP BY platform), o AS (SELECT platform, count(*) AS n FROM c WHERE known GROUP BY platform)
          SELECT r.platform, CASE WHEN capped THEN 'partial' ELSE 'completed' END AS status, CASE WHEN NOT capped THEN CAST(newest AS VARCHAR) END AS first, CASE WHEN NOT capped THEN least(20, r.n + coalesce(o.n, 0) - CASE WHEN o.n IS NULL THEN 0 ELSE 1 END) END AS n
          FROM r LEFT JOIN o USING (platform)""",
        "content_rules": r"""WITH b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://e.org/a b' || chr(10) || '## 图片' || chr(10) || chr(10) || '- ' || coalesce(text, '') WHEN 1 THEN translate(coalesce(text, ''), 'entiasourl', '检索检索检索检索检索') ELSE coalesce(text, '') END AS body FROM documents),
          m AS (SELECT *, regexp_replace(regexp_replace(body, '(?ms)^##\s*(媒体|图片).*', ''), 'https?://\S+', '', 'g') AS bare, regexp_replace(body, '[\s\pZ]', '', 'g') AS solid FROM b)
          SELECT doc_id, CASE WHEN length(regexp_replace(bare, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')) < 4 THEN 'unreadable' WHEN length(body) >= 200 AND doc_id % 3 = 0 THEN 'not_shorter' END AS summary,
            CASE WHEN solid <> '' AND CAST(length(regexp_replace(solid, '[^\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]', '', 'g')) AS DOUBLE) / length(solid) >= 0.5 AND doc_id % 2 <> 0 THEN 'no_cjk' END AS tags FROM m""",
        "folded_tags": "SELECT doc_id, 'strasse ' || lower(source) || '|σίσυφοσ|file' AS tags FROM documents WHERE source IS NOT NULL",
        "evidence_assets": r"""WITH e AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 7 <> 0 AND regexp_matches(coalesce(text, ''), '[^ \t-\r]') THEN 'body' END, CASE WHEN doc_id % 2 = 0 THEN 'transcript' END, CASE WHEN doc_id % 3 = 0 THEN 'ocr' END], lambda x: x IS NOT NULL) AS s FROM documents)
          SELECT doc_id, CASE len(s) WHEN 0 THEN 'title_only' WHEN 1 THEN s[1] ELSE 'mixed' END AS level, array_to_string(s, '|') AS sources, CASE WHEN len(s) = 0 THEN 0.75e0 WHEN s = ['body'] THEN 0.95e0 ELSE 1e0 END AS factor FROM e""",
        "index_overview": f"""WITH {i}, a AS (SELECT doc_id, access_status = 'available' AS up, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS done, doc_id % 4 <> 0 AS held, doc_id % 6 = 0 AS old FROM items)
          SELECT count(*) FILTER (WHERE up AND done) AS indexed_items, count(*) FILTER (WHERE up AND done AND held AND NOT old) AS indexed_chunks, count(*) FILTER (WHERE NOT done) AS pending, count(*) FILTER (WHERE doc_id % 14 = 0) AS failed,
            count(*) FILTER (WHERE held AND old) AS stale, count(*) FILTER (WHERE NOT up) AS unavailable, 'available' AS state FROM a""",
        "reconciled_tasks": f"WITH {i} SELECT platform, {sid} AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'running' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'pending' ELSE 'completed' END AS status FROM items",
        "page_repairs": f"WITH {i}, m AS ({item_markdown}) SELECT platform, {sid} AS source_id, digest, CASE WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM m JOIN items USING (doc_id) WHERE doc_id % 4 = 0 OR doc_id % 6 = 0",
    }
