"""Whole imports as one job: rows of a newest-first scan are cut at the frontier, submitted in batches, and the scan is finished."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import ingest


def import_scan(rows: DataFrame, frontiers: DataFrame, state: DataFrame, receipts: DataFrame, job: str, mode: str = "incremental", cap: int | None = None, since=None, until=None, keep: str = "with", size: int = 20, span: int = 10_000) -> dict[str, DataFrame]:
    """Import items (columns of ``ingest.submit`` without job, key and pos, and ``seq``, a whole number from the newest on).

    Every platform in ``rows`` is a run of ``job``. An incremental run is handed its frontier and keeps the rows ``keep`` (before, with or page) the first known id; a full one keeps all. The rest go in batches of
    ``size`` (0: one a platform) named by number, so a job that is run again replays its receipts. A run whose cap cut rows off is partial and leaves its
    frontier; the others are completed, and the newest ids that were scanned become the frontier. Out come ``runs``, ``frontiers``, and what ``submit`` gives. An import that fails half way leaves what was written of it,
    and ``fail_open`` ends its runs.

    Rows are numbered within slices of ``span`` of ``seq`` and the slices by their counts, so no platform is sorted in one task.
    """
    spark = rows.sparkSession
    r = rows.withColumn("job_id", F.lit(job)).withColumn("_slice", F.floor(F.col("seq") / span))
    counts = r.groupBy("platform", "_slice").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("platform").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("platform", "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    within = F.row_number().over(Window.partitionBy("platform", "_slice").orderBy("seq", "source_id")) - 1
    r = r.withColumn("pos", within).join(counts, ["platform", "_slice"]).withColumn("pos", (F.col("_off") + F.col("pos")).cast("int")).drop("_slice", "_off")
    page = F.floor(F.col("pos") / size) if size else F.lit(0).cast("long")
    r = r.withColumn("page", page)
    asked = rows.select("platform").distinct().groupBy().agg(F.array_sort(F.collect_set("platform")).alias("platforms"))  # a few names
    asked = asked.select(F.lit(job).alias("job_id"), F.lit(mode).alias("mode"), F.lit(cap).cast("long").alias("cap"), F.lit(since).cast("timestamp").alias("since"), F.lit(until).cast("timestamp").alias("until"), "platforms")
    runs = ingest.start(asked, frontiers)
    known = runs.select("job_id", "platform", F.col("frontier").alias("ids"))
    kept = ingest.cut_at_frontier(r, known, keep)
    batch = kept.withColumn("key", F.col("page").cast("string")).withColumn("arrival", F.col("page")).withColumn("_scan", F.col("pos"))
    batch = batch.withColumn("pos", (F.col("pos") - F.col("page") * size).cast("int") if size else F.col("pos"))
    out = ingest.submit(batch.drop("page", "seq", "_scan"), receipts, runs.drop("frontier"), state)  # a frontier may be long, and each batch would carry it
    cut_off = out["receipts"].groupBy("job_id", "platform").agg(F.bool_or("truncated").alias("truncated"))
    newest = batch.where(F.col("_scan") < ingest.FRONTIER)
    newest = newest.where(F.col("_scan") < F.lit(cap)) if cap is not None else newest
    ids = newest.groupBy("job_id", "platform").agg(F.transform(F.array_sort(F.collect_list(F.struct("_scan", "source_id"))), lambda x: x["source_id"]).alias("ids"))
    result = runs.select("job_id", "platform").join(cut_off, ["job_id", "platform"], "left").join(ids, ["job_id", "platform"], "left")
    stop = F.coalesce("truncated", F.lit(False))
    result = result.select("job_id", "platform", (~stop).alias("observed_end"), stop.alias("cap_reached"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    ended, moved = ingest.finish(runs.withColumn("truncated", F.lit(False)), result, frontiers)
    return {"runs": ended.drop("truncated"), "frontiers": moved, **out}


def fail_open(runs: DataFrame, error: str) -> DataFrame:
    """Runs after an import failed: those that have not ended are failed, with the error."""
    live = ~F.col("status").isin(*ingest.TERMINAL)
    return runs.withColumn("error", F.when(live, error)).withColumn("status", F.when(live, "failed").otherwise(F.col("status")))
