"""Queries over snapshots and embedding builds, and their SQL for DuckDB."""

import hashlib

from pyspark.sql import functions as F

from larder import storage
from larder.operators import embed, maintenance
from larder.plans.capture import captured
from larder.sources import snapshots
from larder.sources.binding import items, table

PROFILE = embed.Profile("word-hashes", "1", "counts", 64, hashlib.sha256(b"word-hashes").hexdigest())
LOOKED_UP = [("x", "2"), ("zhihu", "7"), ("github", "41"), ("bilibili", "none")]


def _stored(spark, sf):
    root = storage.folder(spark, "items")
    snapshots.write(captured(spark, sf), root, 8)
    return root


def snapshot_store(spark, sf):
    """Snapshots of all items, written and read again, each with the hash it holds and its errors."""
    got = snapshots.sound(snapshots.read(spark, _stored(spark, sf)))
    return got.select("platform", "source_id", "content_hash", F.sha2("body", 256).alias("body"), F.array_join("collections", "|").alias("collections"))


def item_lookup(spark, sf):
    """The snapshots of a request's items, from the folders they lie in."""
    got = snapshots.find_all(spark, _stored(spark, sf), LOOKED_UP, 8)
    return got.select("platform", "source_id", "title", F.size("errors").cast("long").alias("errors"))


def _files(spark, sf):
    it = items(spark, sf).where("body is not null")
    more = F.when(F.col("content_type") == "video", "transcript/Transcript.md").when(F.col("content_type") == "mixed", "ocr/1.md")
    paths = F.array_compact(F.array(F.lit("content.md"), F.lit("notes.md"), F.lit("assets/raw.md"), more))
    return it.select("platform", "source_id", F.col("body").alias("text"), F.explode(paths).alias("path"))


def item_files(spark, sf):
    """Each item with its snapshot's title, its files and its state."""
    states = items(spark, sf).where("body is not null")
    got = snapshots.get_item(snapshots.read(spark, _stored(spark, sf)), snapshots.index_files(_files(spark, sf)), states, content=True)
    first = F.get(F.transform("content", lambda c: c["path"]), F.lit(0))
    return got.select("platform", "source_id", "title", F.array_join("files", "|").alias("files"), first.alias("first"), "access_status", "content_type")


def embedding_segments(spark, sf):
    """Token windows of every whole text, decoded and embedded; whether each vector is one."""
    got = embed.segments(table(spark, sf, "documents").select("doc_id", "text"), embed.WordHashes, PROFILE)
    got = maintenance.valid_vectors(got, PROFILE.dimensions)
    long = lambda c: F.col(c).cast("long").alias(c)
    return got.select("doc_id", long("segment"), long("begin"), long("finish"), F.sha2("text", 256).alias("digest"), "valid", "error")


def embedding_commit(spark, sf):
    """An embedding build of all items, committed to a library in which some have changed, gone, or were not indexed meanwhile."""
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    made = embed.segments(docs.select("doc_id", h.alias("input_hash"), F.lit(0).alias("chunk_id"), "text"), embed.WordHashes, PROFILE).drop("text")
    state = items(spark, sf).select("doc_id", "access_status", F.sha2(F.coalesce("body", F.lit("")), 256).alias("h"))
    now = state.select("doc_id", "access_status", F.when(i % 7 == 0, "new").otherwise(F.col("h")).alias("index_hash"))
    chunks = state.select("doc_id", F.when(i % 11 == 0, 1).otherwise(0).alias("chunk_id"), F.col("h").alias("input_hash"))
    tasks = state.select("doc_id", F.col("h").alias("input_hash"), F.lit("index_content").alias("kind"), F.when(i % 13 == 0, "pending").otherwise("completed").alias("status"))
    tried = state.where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("n"))
    _, states, _ = embed.commit(made, now, chunks, tasks, tried, PROFILE, PROFILE.id)
    return states.select("doc_id", "status", F.col("attempts").cast("long").alias("attempts"), "vectors")


QUERIES = {f.__name__: f for f in (snapshot_store, item_lookup, item_files, embedding_segments, embedding_commit)}


def sql(items_cte: str, content_hash: str) -> dict[str, str]:
    kind = "['text', 'video', 'mixed'][doc_id % 3 + 1]"
    words = r"words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents)"
    seg = f"""{words}, seg AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, greatest(0, CAST(ceil((len(w) - 480) / 448.0) AS BIGINT)) + 1)) AS segment FROM words WHERE len(w) > 0)"""
    return {
        "snapshot_store": f"WITH {items_cte}, h AS ({content_hash}) SELECT platform, CAST(doc_id AS VARCHAR) AS source_id, digest AS content_hash, sha256(text) AS body, source AS collections FROM h JOIN items USING (doc_id) JOIN documents USING (doc_id)",
        "item_lookup": f"WITH {items_cte} SELECT platform, CAST(doc_id AS VARCHAR) AS source_id, 'item ' || doc_id AS title, CAST(0 AS BIGINT) AS errors FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL AND (platform, CAST(doc_id AS VARCHAR)) IN ({', '.join(map(str, LOOKED_UP))})",
        "item_files": f"""WITH {items_cte}, k AS (SELECT doc_id, platform, access_status, {kind} AS content_type FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL)
          SELECT platform, CAST(doc_id AS VARCHAR) AS source_id, 'item ' || doc_id AS title, CASE content_type WHEN 'video' THEN 'content.md|source.json|transcript/Transcript.md' WHEN 'mixed' THEN 'content.md|ocr/1.md|source.json' ELSE 'content.md|source.json' END AS files,
            'content.md' AS first, access_status, content_type FROM k""",
        "embedding_segments": f"""WITH {seg} SELECT doc_id, segment, segment * 448 AS begin, CAST(least(n, segment * 448 + 480) AS BIGINT) AS finish, sha256(array_to_string(w[segment * 448 + 1:segment * 448 + 480], ' ')) AS digest, true AS valid,
          CAST(NULL AS VARCHAR) AS error FROM seg""",
        "embedding_commit": f"""WITH {items_cte}, {seg}, v AS (SELECT doc_id, count(*) AS vectors FROM seg GROUP BY doc_id)
          SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND access_status = 'available' THEN 'completed' WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'pending' END AS status,
            CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts, vectors FROM v JOIN items USING (doc_id)""",
    }
