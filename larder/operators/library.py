"""Library state: folders, upserts, reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fields


def collection_map(items: DataFrame, filed: DataFrame) -> DataFrame:
    """Available items per platform and folder."""
    ok = items.where("access_status = 'available'").select("doc_id", "platform")
    return ok.join(filed, "doc_id").groupBy("platform", "name").agg(F.countDistinct("doc_id").alias("n"))


def platform_coverage(items: DataFrame, filed: DataFrame) -> DataFrame:
    """Items per platform, and how many are in no folder or unavailable."""
    got = items.join(filed.select("doc_id", F.lit(1).alias("f")).distinct(), "doc_id", "left")
    return got.groupBy("platform").agg(
        F.count("*").alias("items"), F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)).alias("unfiled"),
        F.sum(F.when(F.col("access_status") == "unavailable", 1).otherwise(0)).alias("unavailable"),
    )


def folder_dedup(seen: DataFrame, key: str, folder: str, fav: str, seq: str) -> DataFrame:
    """One row per item: sorted folders, earliest favourite, first entry seen."""
    return seen.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(folder)), "|").alias("folders"), F.min(fav).alias("first_fav"), F.min(seq).alias("first_seen"))


def classify_upsert(state: DataFrame, batch: DataFrame, key: str, digest: str) -> DataFrame:
    """Each row of ``batch`` as added, refreshed or duplicate against ``state``."""
    old = state.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_has"))
    kind = F.when(F.col("_has").isNull(), "added").when(F.col("_old").eqNullSafe(F.col(digest)), "duplicate").otherwise("refreshed")
    return batch.join(old, key, "left").withColumn("change", kind).drop("_old", "_has")


def missing(published: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``published`` whose keys ``known`` lacks."""
    return published.join(known.select(*keys), keys, "left_anti")


def merge_favorites(state: DataFrame, batch: DataFrame, key: str, fav: str) -> DataFrame:
    """Earliest favourite time of state and batch; a missing time never wins."""
    both = state.select(key, F.col(fav).alias("_a")).join(batch.select(key, F.col(fav).alias("_b")), key, "full")
    return both.select(key, F.least("_a", "_b").alias(fav))


def asset_diff(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Each asset as added, stale or kept."""
    both = state.select(key, F.lit(True).alias("_s")).join(batch.select(key, F.lit(True).alias("_b")), key, "full")
    return both.select(key, F.when(F.col("_s").isNull(), "added").when(F.col("_b").isNull(), "stale").otherwise("kept").alias("change"))


def id_collisions(ids: DataFrame, key: str) -> DataFrame:
    """Ids that differ only in case."""
    return ids.where(F.col(key).isNotNull()).groupBy(F.lower(key).alias("folded")).agg(F.countDistinct(key).alias("variants")).where("variants > 1")


def evidence(items: DataFrame) -> DataFrame:
    """Evidence level and rank factor of each item, from its body and its captured text assets."""
    body = F.coalesce(F.col("body").rlike(r"[^ \t-\r]"), F.lit(False))
    asset = F.when(F.col("content_type") == "video", "transcript").when(F.col("content_type") == "mixed", "ocr")
    level = F.when(~body & asset.isNull(), "title_only").when(body & asset.isNotNull(), "mixed").when(body, "body").otherwise(asset)
    out = items.withColumn("level", level)
    return out.withColumn("factor", F.when(F.col("level") == "title_only", 0.75).when(F.col("level") == "body", 0.95).otherwise(1.0))


def evidence_of(body: Column, paths: Column) -> Column:
    """(level, sources, factor) of an item from its body and the paths of its captured text files. Unsafe paths and others than transcripts and OCR do not count, nor does a summary, which is no part of the body."""
    safe = F.filter(F.coalesce(paths, F.array().cast("array<string>")), fields.safe_path)
    kind = lambda p: F.when(p.startswith("transcript/"), "transcript").when(p.startswith("ocr/"), "ocr")
    own = F.when(~fields.blank(body), "body")
    sources = F.array_distinct(F.array_compact(F.concat(F.array(own), F.transform(safe, kind))))
    level = F.when(F.size(sources) == 0, "title_only").when(F.size(sources) > 1, "mixed").otherwise(F.get(sources, F.lit(0)))
    factor = F.when(F.size(sources) == 0, 0.75).when((F.size(sources) == 1) & (F.get(sources, F.lit(0)) == "body"), 0.95).otherwise(1.0)
    return F.struct(level.alias("level"), sources.alias("sources"), factor.alias("factor"))


def index_summary(items: DataFrame, chunks: DataFrame, tasks: DataFrame, available: bool) -> DataFrame:
    """One row: items and chunks that are indexed, index tasks pending and failed (a failed one waits again, so it is both), chunks of older hashes, items that are not available, and the state of the index.

    ``items`` (platform, source_id, access_status, index_hash), ``chunks`` (platform, source_id, input_hash), ``tasks`` (platform, source_id, kind, input_hash, status, error).
    """
    by = ["platform", "source_id"]
    index = tasks.where("kind = 'index_content'")
    done = index.where("status = 'completed'").select(*by, F.col("input_hash").alias("index_hash")).distinct()
    ok = items.where("access_status = 'available' and index_hash is not null").join(done, [*by, "index_hash"], "left_semi")
    c = chunks.join(items.select(*by, "index_hash"), by).agg(F.count_if(~F.col("input_hash").eqNullSafe(F.col("index_hash"))).alias("stale"))
    live = chunks.join(ok.select(*by, F.col("index_hash").alias("input_hash")), [*by, "input_hash"], "left_semi").agg(F.count("*").alias("indexed_chunks"))
    t = index.agg(F.count_if(F.col("status").isin("pending", "running")).alias("pending"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    i = items.agg(F.count_if(F.col("access_status") != "available").alias("unavailable"))
    # One-row totals side by side.
    return ok.agg(F.count("*").alias("indexed_items")).crossJoin(live).crossJoin(t).crossJoin(c).crossJoin(i).withColumn("state", F.lit("available" if available else "index_unavailable"))


def content_repairs(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    """Items whose stored page (platform, source_id, text) is missing or another than the rendered one: what to write."""
    by = ["platform", "source_id"]
    both = rendered.join(stored.select(*by, F.col("text").alias("_was")), by, "left")
    return both.where(~F.col("text").eqNullSafe(F.col("_was"))).select(*by, "text", F.when(F.col("_was").isNull(), "missing").otherwise("changed").alias("reason"))
