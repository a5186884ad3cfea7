"""Task queue, enrichment, backfills, re-indexing and repair: each reads state tables and gives rows of change."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.hashes import tagged_hash

ITEM = ["platform", "source_id"]
TASK = [*ITEM, "kind", "input_hash"]


def task_id() -> Column:
    return tagged_hash("task", *[F.col(c) for c in TASK])


def enqueue(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """New pending tasks for (platform, source_id, kind, input_hash) that no task has; asking again adds nothing."""
    new = wanted.select(*TASK, "created").dropDuplicates(TASK).join(tasks.select(*TASK), TASK, "left_anti")
    return new.withColumn("task_id", task_id()).withColumn("status", F.lit("pending"))


def next_tasks(tasks: DataFrame, n: int, kind: str, platforms: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """The ``n`` oldest pending tasks of a kind, ties by id."""
    t = tasks.where((F.col("status") == "pending") & (F.col("kind") == kind))
    t = t.where(F.col("platform").isin(*platforms)) if platforms else t
    t = t.where(~F.col("task_id").isin(*excluded)) if excluded else t
    return t.orderBy("created", "task_id").limit(n)


def settle(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks after results (task_id, outcome: claim, complete, fail, decline, reset). Only running tasks may leave that state; failed ones wait again."""
    t = tasks.join(results, "task_id", "left")
    o, running = F.col("outcome"), F.col("status") == "running"
    rule = F.when((F.col("status") == "pending") & (o == "claim"), "running").when(running & (o == "complete"), "completed").when(running & o.isin("fail", "reset"), "pending").when(running & (o == "decline"), "declined")
    return t.withColumn("status", rule.otherwise(F.col("status"))).select(*tasks.columns)


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks after a crash: what ran waits again."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def supersede(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Pending summaries of items that are unavailable or have another hash by now are completed while claiming."""
    i = items.select(*ITEM, F.col("content_hash").alias("_h"), F.col("access_status").alias("_s"))
    t = tasks.join(i, ITEM, "left")
    stale = (F.col("kind") == "summarize") & (F.col("status") == "pending") & ~F.coalesce((F.col("_h") == F.col("input_hash")) & (F.col("_s") == "available"), F.lit(False))
    return t.withColumn("status", F.when(stale, "completed").otherwise(F.col("status"))).select(*tasks.columns)


def apply_enrichment(submitted: DataFrame, items: DataFrame) -> DataFrame:
    """Submitted enrichments (platform, source_id, input_hash, ...) as applied, or stale where the content has changed since."""
    i = items.select(*ITEM, F.col("content_hash").alias("_h"))
    return submitted.join(i, ITEM, "left").withColumn("result", F.when(F.col("_h") == F.col("input_hash"), "applied").otherwise("stale")).drop("_h")


def redo(tasks: DataFrame, enriched: DataFrame, model: str | None = None, declined: bool = False) -> DataFrame:
    """Summaries to make again: of one model, or those declined; back to pending."""
    done = tasks.where("kind = 'summarize'").where("status = 'declined'" if declined else "status = 'completed'")
    done = done if declined or model is None else done.join(enriched.where(F.col("model") == model).select(*ITEM), ITEM, "left_semi")
    return done.withColumn("status", F.lit("pending"))


def summaries_missing(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Available items without a summary task for their hash."""
    want = items.where("access_status = 'available'").select(*ITEM, F.lit("summarize").alias("kind"), F.col("content_hash").alias("input_hash"))
    return want.join(tasks.select(*TASK), TASK, "left_anti")


def backfill(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Update plan from snapshots (platform, source_id, favorited_at, source_status): earlier favourites fill in, informed statuses correct; ``changed`` tells which rows move.

    A status that says nothing keeps what is stored; ``missing`` items are repaired elsewhere.
    """
    from larder.operators.ingest import access_status

    s = snapshots.select(*ITEM, F.col("favorited_at").alias("_f"), access_status(F.col("source_status")).alias("_s"))
    p = items.join(s, ITEM)
    fav, status = F.least("favorited_at", "_f"), F.when(F.col("access_status") == "missing", F.col("access_status")).otherwise(F.coalesce("_s", "access_status"))
    changed = ~fav.eqNullSafe(F.col("favorited_at")) | ~status.eqNullSafe(F.col("access_status"))
    return p.select(*ITEM, fav.alias("favorited_at"), status.alias("access_status"), changed.alias("changed"))


def backfill_report(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("seen"), F.count_if("changed").alias("changed"), F.count_if(F.col("favorited_at").isNotNull()).alias("dated"), F.count_if(F.col("access_status") == "unavailable").alias("unavailable"))


def add_folders(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Folders of items after a run: it adds, and never drops."""
    return stored.unionByName(seen.select(*stored.columns)).dropDuplicates([*ITEM, "name"])


def stale_indexes(items: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Items to index again: no chunks, chunks of another hash, or all that are available (``force``)."""
    held = chunks.groupBy(*ITEM).agg(F.count("*").alias("_n"), F.max("input_hash").alias("_h"), F.min("input_hash").alias("_l"))
    i = items.where("access_status = 'available'").join(held, ITEM, "left")
    good = (F.col("_h") == F.col("index_hash")) & (F.col("_l") == F.col("index_hash"))
    return i.where(F.lit(force) | ~F.coalesce(good, F.lit(False))).select(*ITEM, "index_hash")


def segment_faults(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Segments (chunk_id, begin, finish) that are missing from ``actual``, and those it should not hold."""
    keys = ["chunk_id", "begin", "finish"]
    return expected.select(*keys).join(actual.select(*keys), keys, "left_anti").withColumn("fault", F.lit("missing")).union(actual.select(*keys).join(expected.select(*keys), keys, "left_anti").withColumn("fault", F.lit("extra")))


def reconcile(tasks: DataFrame, faults: DataFrame, segments: DataFrame, force: bool = False) -> DataFrame:
    """Embedding tasks after a check: a completed one of an item with a fault (``segment_faults``) waits again, with ``force`` all completed ones; others stay.

    ``segments`` (chunk_id, platform, source_id) says whose a chunk is. A task that runs is left to its run.
    """
    bad = faults.select("chunk_id").distinct().join(segments.select("chunk_id", *ITEM).distinct(), "chunk_id").select(*ITEM, F.lit(True).alias("_bad")).distinct()
    t = tasks.join(bad, ITEM, "left")
    again = (F.col("kind") == "embed") & (F.col("status") == "completed") & (F.lit(force) | F.coalesce("_bad", F.lit(False)))
    return t.withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).select(*tasks.columns)


def valid_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """``valid``: finite, of ``dims`` numbers and unit length (within 1e-5 of it, or 1e-6)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ok = (F.size("vector") == dims) & F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(norm - 1) <= F.greatest(F.lit(1e-6), 1e-5 * F.greatest(norm, F.lit(1.0))))
    return vectors.withColumn("valid", F.coalesce(ok, F.lit(False)))


def eligible_chunks(chunks: DataFrame, items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Chunks that may be searched or embedded: the item is available, the chunk has its hash, and indexing of that hash is done."""
    c = chunks.join(items.where("access_status = 'available'").select(*ITEM, F.col("index_hash").alias("input_hash")), [*ITEM, "input_hash"], "left_semi")
    done = tasks.where("kind = 'index_content' and status = 'completed'")
    return c.join(done.select(*ITEM, "input_hash"), [*ITEM, "input_hash"], "left_semi")


def current_vectors(vectors: DataFrame, chunks: DataFrame, tasks: DataFrame, profile: str) -> DataFrame:
    """Vectors of eligible chunks whose embedding task, named by profile and hash, is done."""
    named = chunks.withColumn("task_hash", tagged_hash("embed-v1", F.lit(profile), F.col("input_hash")))
    done = tasks.where("kind = 'embed' and status = 'completed'").select(*ITEM, F.col("input_hash").alias("task_hash"))
    return vectors.join(named.join(done, [*ITEM, "task_hash"], "left_semi").select("chunk_id", *ITEM, "ordinal"), "chunk_id")


def maintenance(snapshots: DataFrame, items: DataFrame) -> DataFrame:
    """What start-up does for each item: register (snapshot only), missing (row only), repair (came back), or keep. Unavailable items are never raised."""
    both = snapshots.select(*ITEM, F.lit(True).alias("_s")).join(items.select(*ITEM, "access_status"), ITEM, "full")
    rule = F.when(F.col("access_status").isNull(), "register").when(F.col("access_status") == "unavailable", "keep").when(F.col("_s").isNull(), F.when(F.col("access_status") == "missing", "keep").otherwise("missing"))
    return both.select(*ITEM, rule.when(F.col("access_status") == "missing", "repair").otherwise("keep").alias("action"))


def activate(profiles: DataFrame, profile_id: str) -> DataFrame:
    """Profiles with one active."""
    return profiles.withColumn("active", F.col("profile_id") == profile_id)


def embedding_status(chunks: DataFrame, vectors: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: current chunks, those with a valid vector, corrupt vectors, open and failed tasks, and the state they make."""
    good = vectors.groupBy("chunk_id").agg(F.bool_or("valid").alias("ok"), F.count_if(~F.col("valid")).alias("bad"))
    c = chunks.select("chunk_id").join(good, "chunk_id", "left").agg(F.count("*").alias("current"), F.count_if(F.coalesce("ok", F.lit(False))).alias("embedded"), F.coalesce(F.sum("bad"), F.lit(0)).alias("corrupt"))
    t = tasks.where("kind = 'embed'").agg(F.count_if(F.col("status").isin("pending", "running")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    rule = F.when((F.col("corrupt") > 0) | (F.col("failed") > 0), "degraded").when(F.col("embedded") < F.col("current"), "partial")
    return c.crossJoin(t).withColumn("state", rule.otherwise("ready"))  # two one-row totals


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """(rate, seconds left); null until something is done."""
    rate = F.try_divide(done, F.nullif(seconds, F.lit(0)))
    return F.struct(rate.alias("rate"), F.try_divide(total - done, F.nullif(rate, F.lit(0))).alias("left"))


def counters(text: Column) -> Column:
    """Counters of a run from JSON; absent ones are 0, negative ones an error."""
    names = ("scanned", "added", "refreshed", "duplicates", "out_of_range")
    c = F.from_json(text, ", ".join(f"{n} long" for n in names))
    bad = F.raise_error(F.lit("negative counter")).cast("long")
    return F.struct(*[F.when(F.coalesce(c[n], F.lit(0)) < 0, bad).otherwise(F.coalesce(c[n], F.lit(0))).alias(n) for n in names])


def rubric(scores: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Pass or fail of an answer set: means of its dimensions (at least 3.0 each, and as many as ``dimensions`` where that is given; six for the whole rubric), covered over claims (micro, at least 0.9; no claims count as all), no hard failure.

    Rows: question, dimensions (map from name to score), covered, claims, hard_failure.
    """
    d = scores.select(F.explode("dimensions").alias("name", "score")).groupBy("name").agg(F.avg("score").alias("mean")).agg(F.min("mean").alias("lowest"), F.count("*").alias("dimensions"))
    t = scores.agg(F.coalesce(F.try_divide(F.sum("covered"), F.nullif(F.sum("claims"), F.lit(0))), F.lit(1.0)).alias("coverage"), F.count_if("hard_failure").alias("hard_failures"))
    return d.crossJoin(t).withColumn("passed", (F.lit(dimensions is None) | (F.col("dimensions") == (dimensions or 0))) & (F.col("lowest") >= 3.0) & (F.col("coverage") >= 0.9) & (F.col("hard_failures") == 0))  # two one-row totals


def content_budget(files: DataFrame, by: list[str], order: list[str], most: int = 100_000) -> DataFrame:
    """Texts of an item's files cut to ``most`` characters in all, in order, with ``truncated``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), most - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return files.withColumn("_room", room.cast("int")).withColumn("truncated", F.length("text") > F.col("_room")).withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("_room"))).drop("_room")
