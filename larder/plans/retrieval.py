"""Queries over the stored index, and their SQL for DuckDB."""

from pyspark.sql import functions as F

from larder import storage
from larder.operators import index, ingest, library, search
from larder.plans.shared import asked, events, index_rows, lexical, semantic
from larder.sources import protocol
from larder.sources.binding import items, table

PHRASES = [(1, "检索"), (2, "检索检"), (3, "th检 of"), (4, "...")]


def _shown(df):
    return df.select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score")


def phrase_search(spark, sf):
    """All hits of phrases of one to three terms, with two letters of every text written as ideographs, so that runs of all lengths occur."""
    rows = index_rows(spark, sf).withColumn("text", F.translate("text", "en", "检索"))
    root = storage.folder(spark, "index")
    index.build(rows, root)
    return _shown(index.search(spark, root, spark.createDataFrame(PHRASES, "query_id int, text string")))


def index_refresh(spark, sf):
    """An index of all texts, then every labelled item again under a heading by its labels, as after an enrichment; items labelled toxic leave."""
    rows, root = index_rows(spark, sf), storage.folder(spark, "index")
    index.build(rows, root)
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    heading = F.when(F.col("quality") == 1, "the worthy clown").otherwise("eau")
    stay = labels.where("toxic = 0")
    fresh = index_rows(spark, sf, stay).drop("heading").join(stay, "doc_id").withColumn("heading", heading)
    index.reindex(fresh, labels, root)
    return _shown(index.search(spark, root, asked(spark)))


def schema_versions(spark, sf):
    """Chunks written by two schema versions, the older without CJK pairs, read as one table of the newer."""
    rows = index_rows(spark, sf).withColumn("text", F.translate("text", "en", "检索"))
    root, old = storage.folder(spark, "chunks"), F.col("doc_id") % 2 == 0
    rows.where(old).write.parquet(f"{root}/v1")
    rows.where(~old).withColumn("pairs", F.when(F.col("ordinal") == 0, index.cjk_bigrams(F.col("text")))).write.parquet(f"{root}/v2")
    got = index.read_chunks(spark, {1: f"{root}/v1", 2: f"{root}/v2"})
    return got.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("text", 256).alias("text"), F.sha2("pairs", 256).alias("pairs"))


def progressive_search(spark, sf):
    """Five items a query that are labelled toxic: pools grow until they hold as many."""
    it = items(spark, sf)
    near = search.top(semantic(spark, sf).join(it.select("doc_id"), "doc_id", "left_semi"), 500).withColumn("ordinal", F.lit(0))
    evidence = library.evidence(it).join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    wide = search.widen(search.rank_lexical(lexical(spark, sf), it), near, it, evidence, 5)
    return search.group_hits(wide, evidence, 5).select("query_id", "pool", "rank", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "supporting")


def message_codes(spark, sf):
    """An envelope around the properties of every event, some of them bent, and the code each gets."""
    i = F.col("event_id") % 8
    payload = F.format_string('{"a": [{"deep": %s}], "said": "the \\"token\\": x"}', F.when(i == 1, '{"X-CSRF-Value": 1}').when(i == 2, '{"a": {"b": [1, {"authToken": 2}]}}').when(i == 3, '[[[{"Set-Cookie": null}]]]').otherwise(F.col("props")))
    raw = F.format_string('{"protocolVersion": %s, "requestId": "r%s", "type": "%s", "payload": %s%s}', F.when(i == 4, "2").when(i == 5, "true").otherwise("1"), F.col("event_id").cast("string"), F.when(i == 6, "other").otherwise("capture.response"), payload, F.when(i == 7, ', "more": 1').otherwise(""))
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(raw, F.lit("]"))).otherwise(raw)
    got = protocol.decode(table(spark, sf, "events").select("event_id", raw.alias("raw")))
    return got.select("event_id", "code", "request_id", F.try_variant_get("payload", "$.a[0].deep.k", "string").alias("k"))


def event_routes(spark, sf):
    """An event of every item, routed to the parser of its platform, some refused."""
    it, i = items(spark, sf), F.col("doc_id")
    kind = F.when(F.col("platform") == "x", "x.bookmarks_page").when(F.col("platform") == "bilibili", "bilibili.video_bundle").when(F.col("platform") == "zhihu", "zhihu.items_page").otherwise("github.page")
    payload = F.to_json(F.struct(
        F.when(i % 7 == 0, "x").otherwise(F.col("platform")).alias("platform"), F.when(i % 5 == 0, "other").otherwise(kind).alias("kind"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("scopeId"),
        F.when(i % 11 == 0, "<html>").otherwise('{"data": []}').alias("body"), F.struct(F.col("source_id").alias("bvid")).alias("resource"),
    ))
    e = it.select("doc_id", F.lit("j").alias("job_id"), F.col("platform").alias("session_platform"), F.try_parse_json(payload).alias("payload"))
    scopes = spark.createDataFrame([("j", p, s) for p in protocol.SCOPED for s in ("s0", "s1")], "job_id string, platform string, scope_id string")
    return protocol.route(e, scopes).select("doc_id", "route", "code")


def scope_status(spark, sf):
    """Runs by user with the kinds of events as scopes: results applied in order of time, and one status row a run."""
    e = events(spark, sf).withColumn("job_id", F.lit("j")).withColumn("platform", F.col("user_id").cast("string"))
    keys = ["job_id", "platform", F.col("event_type").alias("scope_id")]
    runs = e.select("job_id", "platform", F.lit("running").alias("status")).distinct()
    scopes = e.where("event_type <> 'error'").select(*keys, F.initcap("event_type").alias("name"), F.lit("running").alias("status"), F.lit(False).alias("cap_reached"), F.lit(None).cast("long").alias("visible_total")).distinct()
    results = e.where("event_type <> 'click'").select(*keys, (F.col("event_id") % 2 == 0).alias("cap_reached"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("visible_total"), F.struct("at", "event_id").alias("at"))
    receipts = e.groupBy(*keys).agg(F.count("*").alias("scanned"), F.count_if(F.col("event_id") % 4 == 0).alias("added")).withColumns({c: F.lit(0) for c in ("refreshed", "duplicates", "out_of_range")})
    got = ingest.run_status(runs, ingest.apply_scope_results(scopes, results), receipts)
    text = F.array_join(F.transform("scopes", lambda s: F.concat_ws(":", s["scope_id"], s["name"], s["scanned"].cast("string"), s["cap_reached"].cast("string"), F.coalesce(s["visible_total"].cast("string"), F.lit("-")))), "|")
    return got.select("platform", "status", "scanned", "added", text.alias("scopes"))


QUERIES = {f.__name__: f for f in (phrase_search, index_refresh, schema_versions, progressive_search, message_codes, event_routes, scope_status)}


def sql(chunk_cte: str, fused_ctes: str, platforms: str) -> dict[str, str]:
    tok = lambda c: rf"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    pairs = r"""array_to_string(list_filter(list_transform(regexp_extract_all(z, '[检索]+|[^检索]+'), lambda x: CASE WHEN regexp_full_match(x, '[检索]{2,}')
        THEN array_to_string(list_transform(range(1, length(x)), lambda i: substring(x, i, 2)), ' ') ELSE regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') END), lambda x: x <> ''), ' ')"""
    z = f"{chunk_cte}, z AS (SELECT doc_id, ordinal, translate(text, 'en', '检索') AS z FROM ch), y AS (SELECT doc_id, ordinal, z, CASE WHEN regexp_matches(z, '[检索]') THEN {pairs} ELSE regexp_replace(z, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') END AS p FROM z)"
    bm = """st AS (SELECT count(*) AS n, avg(l) AS a FROM f), df AS (SELECT phrase, count(*) AS df FROM post GROUP BY phrase)
      SELECT query_id, doc_id, ordinal, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / a))), 6) AS score
      FROM post JOIN df USING (phrase) JOIN q USING (phrase) CROSS JOIN st GROUP BY query_id, doc_id, ordinal"""
    # Each phrase beside its terms; a token list meets a phrase where the list's slice equals the terms.
    many = lambda x: f"len(list_filter(range(1, len({x}) + 1), lambda i: {x}[i:i + len(terms) - 1] = terms))"
    return {
        "phrase_search": f"""WITH {z}, q(query_id, phrase, terms) AS (VALUES (1, 'a', ['检索']), (2, 'b', ['检索', '索检']), (3, 'c', ['th', '检']), (3, 'd', ['of'])),
          f AS (SELECT doc_id, ordinal, {tok("z")} AS t, {tok("p")} AS b, len({tok("z")}) + len({tok("p")}) AS l FROM y),
          post AS (SELECT * FROM (SELECT phrase, doc_id, ordinal, l, {many("t")} + {many("b")} AS tf FROM f CROSS JOIN q) WHERE tf > 0), {bm}""",
        "index_refresh": f"""WITH {chunk_cte}, q(query_id, phrase) AS (VALUES (1, 'thou'), (1, 'ertion'), (2, 'eau'), (2, 'the'), (3, 'worthless'), (3, 'clown')),
          lb AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
          f0 AS (SELECT ch.doc_id, ordinal, {tok("text")} AS t, CASE WHEN lb.doc_id IS NULL THEN []::VARCHAR[] WHEN quality = 1 THEN ['the', 'worthy', 'clown'] ELSE ['eau'] END AS h FROM ch LEFT JOIN lb ON ch.doc_id = lb.doc_id WHERE coalesce(toxic, 0) = 0),
          f AS (SELECT doc_id, ordinal, list_concat(t, t, h) AS t, 2 * len(t) + len(h) AS l FROM f0),
          post AS (SELECT phrase, doc_id, ordinal, l, count(*) AS tf FROM (SELECT doc_id, ordinal, l, unnest(t) AS phrase FROM f) WHERE phrase IN (SELECT phrase FROM q) GROUP BY ALL), {bm}""",
        "progressive_search": f"""WITH {fused_ctes}, p(pool) AS (VALUES (50), (100), (200), (400), (500)),
          l AS (SELECT pool, lex.* FROM lex JOIN p ON rank <= pool), s AS (SELECT pool, sem.*, 0 AS ordinal FROM sem, p WHERE rank <= 500),
          f0 AS (SELECT pool, query_id, doc_id, ordinal, l.rank AS lr, s.score AS cosine, round(coalesce(1e0 / (60 + l.rank), 0) + coalesce(1e0 / (60 + s.rank), 0), 9) AS score, least(l.rank, s.rank) AS best
            FROM l FULL JOIN s USING (pool, query_id, doc_id, ordinal)),
          f1 AS (SELECT f0.*, platform, row_number() OVER (PARTITION BY pool, query_id ORDER BY score DESC, best, lr NULLS LAST, cosine DESC NULLS LAST, published DESC, platform, CAST(doc_id AS VARCHAR), ordinal) AS rank FROM f0 JOIN items USING (doc_id)),
          f AS (SELECT f1.*, text FROM f1 JOIN documents USING (doc_id) WHERE rank <= pool AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
          n AS (SELECT query_id, pool, count(DISTINCT doc_id) AS n FROM f GROUP BY ALL),
          c AS (SELECT query_id, coalesce(min(pool) FILTER (WHERE n >= 5), 500) AS pool FROM n GROUP BY query_id),
          k AS (SELECT f.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY f.rank) AS i FROM f JOIN c USING (query_id, pool)),
          g AS (SELECT query_id, pool, doc_id, platform, max(ordinal) FILTER (WHERE i = 1) AS ordinal, max(best) FILTER (WHERE i = 1) AS best,
            max(score) FILTER (WHERE i = 1) * max(CASE WHEN doc_id % 3 <> 0 THEN 1e0 WHEN regexp_matches(text, '[^ \t-\r]') THEN 0.95e0 ELSE 0.75e0 END) AS adjusted,
            coalesce(string_agg(CAST(ordinal AS VARCHAR), '|' ORDER BY i) FILTER (WHERE i > 1), '') AS supporting FROM k WHERE i <= 4 GROUP BY query_id, pool, doc_id, platform),
          h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, best, platform, CAST(doc_id AS VARCHAR), ordinal) AS INTEGER) AS rank FROM g)
          SELECT query_id, pool, rank, doc_id, ordinal, supporting FROM h WHERE rank <= 5""",
        "message_codes": """WITH c AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 11 = 0 THEN 'invalid_message' WHEN event_id % 8 = 4 THEN 'protocol_mismatch' WHEN event_id % 8 IN (5, 6, 7) THEN 'invalid_message'
          WHEN event_id % 8 IN (1, 3) THEN 'credential_field_rejected' END AS code FROM events)
          SELECT event_id, code, CASE WHEN code IS NULL THEN 'r' || event_id END AS request_id, CASE WHEN code IS NULL AND event_id % 8 <> 2 THEN k END AS k FROM c""",
        "event_routes": f"""WITH {platforms}, c AS (SELECT doc_id, platform, CASE WHEN platform = 'github' OR doc_id % 5 = 0 OR doc_id % 7 = 0 AND platform <> 'x' OR platform IN ('bilibili', 'zhihu') AND doc_id % 3 = 2 THEN 'invalid_message'
          WHEN doc_id % 11 = 0 AND platform <> 'bilibili' THEN 'page_changed' END AS code FROM items)
          SELECT doc_id, code, CASE WHEN code IS NULL THEN CASE platform WHEN 'x' THEN 'x.bookmarks_page' WHEN 'bilibili' THEN 'bilibili.video_bundle' ELSE 'zhihu.items_page' END END AS route FROM c""",
        "scope_status": """WITH e AS (SELECT user_id, event_type AS t, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
          r AS (SELECT user_id, t, last(event_id ORDER BY sec, event_id) AS e FROM e WHERE t <> 'click' GROUP BY ALL), n AS (SELECT user_id, t, count(*) AS scanned FROM e GROUP BY ALL),
          s AS (SELECT n.user_id, string_agg(t || ':' || upper(t[1]) || t[2:] || ':' || scanned || ':' || (e IS NOT NULL AND e % 2 = 0) || ':' || CASE WHEN e IS NULL OR e % 3 = 0 THEN '-' ELSE CAST(e AS VARCHAR) END, '|' ORDER BY t) AS scopes
            FROM n LEFT JOIN r USING (user_id, t) WHERE t <> 'error' GROUP BY n.user_id)
          SELECT CAST(user_id AS VARCHAR) AS platform, 'running' AS status, count(*) AS scanned, count(*) FILTER (WHERE event_id % 4 = 0) AS added, any_value(scopes) AS scopes FROM e LEFT JOIN s USING (user_id) GROUP BY user_id""",
        "schema_versions": f"WITH {z} SELECT doc_id, ordinal, sha256(z) AS text, sha256(p) AS pairs FROM y",
    }
