"""Registered queries of the engine's own operators and their SQL for DuckDB."""

from pyspark.sql import functions as F

from larder.functions.text import cjk_bigrams
from larder.operators import library, search, sync
from larder.plans import capture, checks, imports, retrieval, state, stored, streams, upkeep
from larder.plans.shared import events, fused, lexical, semantic
from larder.sources.binding import item_collections, items, table


def bm25_search(spark, sf):
    got = search.rank_lexical(lexical(spark, sf), items(spark, sf), 10)
    return got.select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score", "rank")


def chunk_hard_split(spark, sf):
    c = search.chunks(table(spark, sf, "documents").where("text is not null"))
    return c.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


def vector_topk(spark, sf):
    return search.top(semantic(spark, sf, 10), 10)


def rrf_fusion(spark, sf):
    return fused(spark, sf).select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "lexical_rank", "semantic_rank", "score", "best_rank", "match_sources", "rank")


def collection_map(spark, sf):
    return library.collection_map(items(spark, sf), item_collections(spark, sf))


def platform_coverage(spark, sf):
    return library.platform_coverage(items(spark, sf), item_collections(spark, sf))


def published_range(spark, sf):
    return items(spark, sf).where("access_status = 'available' and published between 1704100000 and 1704200000").select("doc_id", "platform", "published")


def favorited_range(spark, sf):
    return items(spark, sf).where("favorited between 1704100000 and 1704500000").select("doc_id", "platform", "favorited")


def folder_dedup(spark, sf):
    seen = items(spark, sf).select("doc_id", "favorited", "published").join(item_collections(spark, sf), "doc_id")
    return library.folder_dedup(seen, "doc_id", "name", "favorited", "published")


def upsert_classify(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    state = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    batch = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return library.classify_upsert(state, batch, "doc_id", "digest").select("doc_id", "change")


def scan_cap(spark, sf):
    e = sync.number_batches(events(spark, sf), ["user_id"], ["at", "event_id"], 50)
    return e.select("event_id", F.col("pos").cast("long").alias("pos"), F.col("batch").cast("long").alias("batch"), "accepted")


def frontier_merge(spark, sf):
    f = sync.frontier(events(spark, sf), ["user_id", "event_type"], "at", "event_id")
    return f.select("user_id", "event_type", "event_id", F.col("pos").cast("long").alias("pos"))


def lease_expiry(spark, sf):
    return sync.leases(events(spark, sf), "user_id", "at")


def transcript_render(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count("*").alias("cues"))
    body = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return c.select("conv_id", "cues", F.sha2(body, 256).alias("digest"))


def citation_ids(spark, sf):
    c = search.chunks(table(spark, sf, "documents").where("text is not null")).join(items(spark, sf).select("doc_id", "platform", "source_id"), "doc_id")
    return c.select("doc_id", F.concat(F.lit("item:"), "platform", F.lit("/"), "source_id", F.lit("#chunk-"), F.col("ordinal").cast("string")).alias("citation"))


def bigrams(spark, sf):
    """Every text, with two of its letters written as ideographs, so that runs of all lengths occur."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(cjk_bigrams(F.translate("text", "en", "检索")), 256).alias("bigrams"))


QUERIES = {
    "bm25_search": bm25_search, "chunk_hard_split": chunk_hard_split, "vector_topk": vector_topk, "rrf_fusion": rrf_fusion,
    "collection_map": collection_map, "platform_coverage": platform_coverage, "published_range": published_range,
    "favorited_range": favorited_range, "folder_dedup": folder_dedup, "upsert_classify": upsert_classify, "scan_cap": scan_cap,
    "frontier_merge": frontier_merge, "lease_expiry": lease_expiry, "transcript_render": transcript_render,
    "citation_ids": citation_ids, "cjk_bigrams": bigrams,
}

_ITEMS = """items AS (SELECT doc_id, ['bilibili', 'github', 'x', 'zhihu'][doc_id % 4 + 1] AS platform, 1704067200 + (doc_id * 37 % 5000) * 60 AS published,
  CASE WHEN doc_id % 5 <> 0 THEN 1704067200 + (doc_id * 37 % 5000) * 60 + (doc_id % 11) * 86400 END AS favorited,
  CASE WHEN doc_id % 17 = 0 THEN 'unavailable' ELSE 'available' END AS access_status FROM documents)"""
_FILED = """filed AS (SELECT doc_id, source AS name FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"""
_CHUNK = """ch AS (SELECT doc_id, i AS ordinal, substring(text, CAST(i * 1080 + 1 AS BIGINT), 1200) AS text FROM (SELECT doc_id, text,
  unnest(range(0, greatest(0, CAST(ceil((length(text) - 1200) / 1080.0) AS BIGINT)) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""
_BM25 = _CHUNK + r""", q(query_id, term) AS (VALUES (1, 'thou'), (1, 'ertion'), (2, 'eau'), (2, 'the'), (3, 'worthless'), (3, 'clown')),
tok AS (SELECT doc_id, ordinal, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM ch),
st AS (SELECT count(*) AS n, avg(2 * len(t)) AS a FROM tok),
post AS (SELECT term, doc_id, ordinal, l, 2 * count(*) AS tf FROM (SELECT doc_id, ordinal, 2 * len(t) AS l, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, doc_id, ordinal, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / a))), 6) AS score
  FROM post JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY query_id, doc_id, ordinal)"""


def _lex(ok: str = "true") -> str:
    """Lexical ranks over the items that pass."""
    return f"""lex AS (SELECT bm.*, platform, published, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, published DESC, platform, CAST(doc_id AS VARCHAR), ordinal) AS INTEGER) AS rank
  FROM bm JOIN items USING (doc_id) WHERE {ok})"""


def _sem(ok: str = "true") -> str:
    return f"""cs AS (SELECT CAST(q.vec_id // 50 + 1 AS INTEGER) AS query_id, v.vec_id AS doc_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS near FROM cs),
sem AS (SELECT query_id, near.doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, near.doc_id) AS INTEGER) AS rank FROM near JOIN items ON items.doc_id = near.doc_id WHERE near <= 500 AND {ok})"""


def _fused(ok: str = "true", pool: int = 100) -> str:
    return f"""{_BM25}, {_ITEMS}, {_lex(ok)}, {_sem(ok)}, l AS (SELECT * FROM lex WHERE rank <= {pool}), s AS (SELECT *, 0 AS ordinal FROM sem WHERE rank <= {pool}),
  f0 AS (SELECT query_id, doc_id, ordinal, l.rank AS lexical_rank, s.rank AS semantic_rank, s.score AS cosine, round(coalesce(1e0 / (60 + l.rank), 0) + coalesce(1e0 / (60 + s.rank), 0), 9) AS score,
    least(l.rank, s.rank) AS best_rank, concat_ws('|', CASE WHEN l.rank IS NOT NULL THEN 'fts' END, CASE WHEN s.rank IS NOT NULL THEN 'vector' END) AS match_sources FROM l FULL JOIN s USING (query_id, doc_id, ordinal)),
  f1 AS (SELECT f0.*, items.platform, items.access_status, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, lexical_rank NULLS LAST, cosine DESC NULLS LAST, items.published DESC, items.platform, CAST(doc_id AS VARCHAR), ordinal) AS INTEGER) AS rank
    FROM f0 JOIN items USING (doc_id)), f AS (SELECT * FROM f1 WHERE rank <= {pool})"""


_EV = "ev AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"
SQL = {
    "bm25_search": f"WITH {_BM25}, {_ITEMS}, {_lex()} SELECT query_id, doc_id, ordinal, score, rank FROM lex WHERE rank <= 10",
    "vector_topk": f"WITH {_ITEMS}, {_sem()} SELECT query_id, doc_id, score, CAST(near AS INTEGER) AS rank FROM near WHERE near <= 10",
    "rrf_fusion": f"WITH {_fused()} SELECT query_id, doc_id, ordinal, lexical_rank, semantic_rank, score, best_rank, match_sources, rank FROM f",
    "chunk_hard_split": f"WITH {_CHUNK} SELECT doc_id, ordinal, length(text) AS n, sha256(text) AS digest FROM ch",
    "citation_ids": f"WITH {_CHUNK}, {_ITEMS} SELECT doc_id, 'item:' || platform || '/' || doc_id || '#chunk-' || ordinal AS citation FROM ch JOIN items USING (doc_id)",
    "collection_map": f"WITH {_ITEMS}, {_FILED} SELECT platform, name, count(DISTINCT doc_id) AS n FROM items JOIN filed USING (doc_id) WHERE access_status = 'available' GROUP BY ALL",
    "platform_coverage": f"""WITH {_ITEMS}, {_FILED} SELECT platform, count(*) AS items, CAST(count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM filed)) AS BIGINT) AS unfiled,
      count(*) FILTER (WHERE access_status = 'unavailable') AS unavailable FROM items GROUP BY platform""",
    "published_range": f"WITH {_ITEMS} SELECT doc_id, platform, published FROM items WHERE access_status = 'available' AND published BETWEEN 1704100000 AND 1704200000",
    "favorited_range": f"WITH {_ITEMS} SELECT doc_id, platform, favorited FROM items WHERE favorited BETWEEN 1704100000 AND 1704500000",
    "folder_dedup": f"""WITH {_ITEMS}, {_FILED} SELECT doc_id, string_agg(DISTINCT name, '|' ORDER BY name) AS folders, min(favorited) AS first_fav, min(published) AS first_seen
      FROM items JOIN filed USING (doc_id) GROUP BY doc_id""",
    "upsert_classify": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 7 = 0 AND text IS NOT NULL THEN 'refreshed' ELSE 'duplicate' END AS change FROM documents",
    "scan_cap": f"WITH {_EV}, p AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS pos FROM ev) SELECT event_id, pos, (pos - 1) // 20 AS batch, pos <= 50 AS accepted FROM p",
    "frontier_merge": f"""WITH {_EV}, m AS (SELECT user_id, event_type, event_id, max(sec) AS sec FROM ev GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sec DESC, event_id DESC) AS pos FROM m) SELECT user_id, event_type, event_id, pos FROM p WHERE pos <= 20""",
    "lease_expiry": f"""WITH {_EV}, g AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) <= 180 THEN 0 ELSE 1 END AS new FROM ev),
      s AS (SELECT user_id, sec, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY sec) AS BIGINT) AS session FROM g)
      SELECT user_id, session, min(sec) AS begun, max(sec) AS ended, count(*) AS beats FROM s GROUP BY ALL""",
    "transcript_render": "SELECT conv_id, count(*) AS cues, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "cjk_bigrams": r"""WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(translate(text, 'en', '检索'), '[检索]+|[^检索]+'), lambda x: CASE WHEN regexp_full_match(x, '[检索]{2,}')
        THEN array_to_string(list_transform(range(1, length(x)), lambda i: substring(x, i, 2)), ' ') ELSE regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') END) AS runs FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, sha256(array_to_string(list_filter(runs, lambda x: x <> ''), ' ')) AS bigrams FROM r""",
}
QUERIES |= state.QUERIES
SQL |= state.sql((_ITEMS, _FILED, _BM25, _lex, _fused, _CHUNK, _EV))
QUERIES |= capture.QUERIES
SQL |= capture.sql(_ITEMS)
QUERIES |= retrieval.QUERIES
SQL |= retrieval.sql(_CHUNK, f"{_BM25}, {_ITEMS}, {_lex()}, {_sem()}", _ITEMS)
QUERIES |= streams.QUERIES
SQL |= streams.sql()
QUERIES |= stored.QUERIES
SQL |= stored.sql(_ITEMS, SQL["content_hash"])
QUERIES |= upkeep.QUERIES
SQL |= upkeep.sql(_ITEMS)
QUERIES |= checks.QUERIES
SQL |= checks.sql(_ITEMS, _BM25, _lex)
QUERIES |= imports.QUERIES
SQL |= imports.sql(_ITEMS, SQL["item_markdown"])
