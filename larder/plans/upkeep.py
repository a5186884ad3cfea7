"""Queries over ingest, queue, scopes and repairs, on items made of the given tables, and their SQL for DuckDB."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import fields, hashes
from larder.operators import ingest, maintenance
from larder.plans.capture import captured
from larder.plans.shared import events
from larder.sources.binding import items, table

CAP = 40


def _id():
    return F.col("doc_id")


def _pick(n, *names):
    return F.element_at(F.array(*map(F.lit, names)), (_id() % n + 1).cast("int"))


def capped_batches(spark, sf):
    """All items in batches of up to five, a cap of forty a platform, and items before a date out of range; batch 10 comes after batch 9."""
    c = captured(spark, sf).withColumn("job_id", F.lit("j")).withColumn("key", F.floor(_id() / 20).cast("string"))
    w = Window.partitionBy("platform", "key").orderBy("doc_id")
    rows = c.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("source_status", F.lit("available")).withColumn("favorited_at", F.lit(None).cast("timestamp"))
    runs = spark.createDataFrame([("j", p, "running", "full", 0, CAP) for p in fields.PLATFORMS], "job_id string, platform string, status string, mode string, scanned long, cap long")
    runs = runs.withColumn("since", F.timestamp_seconds(F.lit(1704100000))).withColumn("until", F.lit(None).cast("timestamp"))
    none = c.select("job_id", "platform", "key", F.lit("").alias("fingerprint")).limit(0)
    state = c.select("platform", "source_id", F.lit("").alias("content_hash"), "published_at", F.col("observed_at").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("favorited_at"), F.lit("available").alias("access_status")).where("cast(source_id as long) % 3 = 0")
    return ingest.submit(rows, none, runs, state)["receipts"].select("platform", "key", "scanned", "added", "refreshed", "duplicates", "out_of_range", "truncated")


def _library(spark, sf):
    it = items(spark, sf).select("doc_id", "platform", "source_id", "access_status", F.sha2(F.coalesce("body", F.lit("")), 256).alias("index_hash"))
    held = F.when(_id() % 6 == 0, F.lit("old")).otherwise(F.col("index_hash"))
    chunks = it.select("platform", "source_id", "doc_id", F.col("source_id").alias("chunk_id"), F.lit(0).alias("ordinal"), held.alias("input_hash"))
    index = it.select("platform", "source_id", F.lit("index_content").alias("kind"), F.col("index_hash").alias("input_hash"), F.when(_id() % 7 == 0, "running").otherwise("completed").alias("status"))
    task = hashes.tagged_hash("embed-v1", F.when(_id() % 5 == 0, "other").otherwise("p"), F.col("index_hash"))
    embed = it.select("platform", "source_id", F.lit("embed").alias("kind"), task.alias("input_hash"), F.when(_id() % 11 == 0, "failed").otherwise("completed").alias("status"))
    return it, chunks, index.union(embed)


def searchable_chunks(spark, sf):
    """Chunks of available items under their current hash whose indexing is done."""
    it, chunks, tasks = _library(spark, sf)
    return maintenance.eligible_chunks(chunks, it, tasks).select("doc_id", "platform")


def current_vectors(spark, sf):
    """Vectors of those chunks whose embedding task, of this profile and hash, is done, and whether each is one."""
    it, chunks, tasks = _library(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    got = maintenance.current_vectors(v, maintenance.eligible_chunks(chunks, it, tasks), tasks, "p")
    return maintenance.valid_vectors(got, 64).select("chunk_id", "platform", "valid")


def embedding_state(spark, sf):
    """Chunks that may be embedded, those with a vector, tasks, and the state that follows."""
    it, chunks, tasks = _library(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    return maintenance.embedding_status(maintenance.eligible_chunks(chunks, it, tasks), maintenance.valid_vectors(v, 64), tasks)


def segment_differences(spark, sf):
    """Windows that a text should have against those that are stored: some missing, some of an older text."""
    n = F.length(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select(_id().cast("string").alias("chunk_id"), F.explode(F.sequence(F.lit(0), F.floor(n / 1000).cast("int"))).alias("i"), _id().alias("doc_id"))
    seg = d.select("doc_id", "chunk_id", "i", (F.col("i") * 1000).alias("begin"), (F.col("i") * 1000 + 1000).alias("finish"))
    stored = seg.where("(doc_id + i) % 9 <> 0").withColumn("finish", F.when((_id() + F.col("i")) % 10 == 0, F.col("finish") + 1).otherwise(F.col("finish")))
    return maintenance.segment_faults(seg, stored).select("chunk_id", F.col("begin").cast("long").alias("begin"), F.col("finish").cast("long").alias("finish"), "fault")


def scope_changes(spark, sf):
    """Folders declared again by a run: kept, renamed, dropped, added, or late."""
    d = table(spark, sf, "documents").select(F.lit("j").alias("job_id"), _pick(4, "bilibili", "github", "x", "zhihu").alias("platform"), _id().cast("string").alias("scope_id"), _id().alias("doc_id"))
    known = d.where("doc_id % 5 <> 0").withColumn("name", F.lit("n"))
    told = d.where("doc_id % 7 <> 0").withColumn("name", F.when(_id() % 3 == 0, "m").otherwise("n"))
    scanned = spark.createDataFrame([("j", "x", 3), ("j", "zhihu", 0)], "job_id string, platform string, scanned long")
    return ingest.register_scopes(known, told, scanned).select("platform", "scope_id", "change")


def scope_finish(spark, sf):
    """Folders of a finished run: those reported advance their frontier, the rest are partial."""
    d = table(spark, sf, "documents").select(F.lit("j").alias("job_id"), F.lit("zhihu").alias("platform"), _id().cast("string").alias("scope_id"), _id().alias("doc_id"))
    runs = d.select("job_id", "platform", "scope_id", F.when(_id() % 9 == 0, "failed").otherwise("running").alias("status"), F.when(_id() % 2 == 0, "full").otherwise("incremental").alias("mode"))
    ids = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda x: F.concat("scope_id", F.lit("-"), x.cast("string")))
    told = d.where("doc_id % 4 <> 0").withColumn("ids", ids(1, 15))
    old = d.where("doc_id % 3 <> 0").select("platform", "scope_id", ids(11, 30).alias("ids"))
    states, frontiers = ingest.finish_scopes(runs, told, old)
    return states.join(frontiers, ["platform", "scope_id"], "left").select("scope_id", "status", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.element_at("ids", -1).alias("last"))


def frontier_cut(spark, sf):
    """Scans of users, newest first in pages of ten, cut at the first event that an older scan knows, in the three ways."""
    e = events(spark, sf).select(F.lit("j").alias("job_id"), F.col("user_id").cast("string").alias("platform"), F.col("event_id").cast("string").alias("source_id"), "at", "event_id", "user_id")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("at").desc(), F.col("event_id").desc())) - 1).withColumn("page", F.floor(F.col("pos") / 10))
    known = e.where("event_id % 13 = 0 and user_id % 4 <> 0").groupBy("job_id", "platform").agg(F.collect_list("source_id").alias("ids"))
    n = [ingest.cut_at_frontier(e, known, mode).groupBy("platform").agg(F.count("*").alias(f"n_{mode}")) for mode in ("before", "with", "page")]
    return n[2].join(n[1], "platform", "left").join(n[0], "platform", "left").select("platform", F.coalesce("n_before", F.lit(0)).alias("n_before"), "n_with", "n_page")


def run_transitions(spark, sf):
    """Runs by user after the control events that the user's events stand for, in order."""
    kind = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), F.when(F.col("event_id") % 2 == 0, "complete").otherwise("fail")).otherwise("note")
    e = events(spark, sf).where("event_id % 5 = 0").select("user_id", F.struct("at", "event_id").alias("at"), kind.alias("event"))
    runs = events(spark, sf).select("user_id").distinct().withColumn("status", F.lit("running"))
    return ingest.apply_transitions(runs, e, ["user_id"]).select("user_id", "status")


def enqueued(spark, sf):
    """Tasks that are new when every item is wanted and most have one."""
    it = items(spark, sf).select("platform", "source_id", "doc_id", F.lit("summarize").alias("kind"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("input_hash"), F.col("published").alias("created"))
    have = it.where("doc_id % 4 <> 0").withColumn("input_hash", F.when(_id() % 10 == 1, "old").otherwise(F.col("input_hash")))
    new = maintenance.enqueue(have, it.union(it))
    return new.select("platform", "source_id", "task_id", "status")


def superseded(spark, sf):
    """Summary tasks after those of gone or changed items were closed."""
    it = items(spark, sf).select("platform", "source_id", "doc_id", "access_status", F.lit("h").alias("content_hash"))
    t = it.select("platform", "source_id", F.when(_id() % 5 == 0, "index_content").otherwise("summarize").alias("kind"), F.when(_id() % 6 == 0, "older").otherwise("h").alias("input_hash"), F.when(_id() % 7 == 0, "running").otherwise("pending").alias("status"))
    return maintenance.supersede(t, it).select("platform", "source_id", "kind", "status")


def enrichment_results(spark, sf):
    """Summaries handed in, as applied or stale, and the tasks of one model to make again."""
    it = items(spark, sf).select("platform", "source_id", "doc_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))
    given = it.select("platform", "source_id", F.when(_id() % 8 == 0, "older").otherwise(F.col("content_hash")).alias("input_hash"))
    tasks = it.select("platform", "source_id", F.lit("summarize").alias("kind"), F.when(_id() % 3 == 0, "declined").otherwise("completed").alias("status"))
    model = it.select("platform", "source_id", _pick(2, "a", "b").alias("model"))
    again = maintenance.redo(tasks, model, "a").union(maintenance.redo(tasks, model, declined=True)).select("platform", "source_id", F.lit(True).alias("again"))
    return maintenance.apply_enrichment(given, it).join(again, ["platform", "source_id"], "left").select("platform", "source_id", "result", F.coalesce("again", F.lit(False)).alias("again"))


def transcripts_kept(spark, sf):
    """Captures, without those that would lose a transcript to a refusal."""
    it = items(spark, sf).select("platform", "source_id", "doc_id")
    seen = it.select("platform", "source_id", _pick(3, "wrong_video", "available", "unavailable").alias("subtitle_status"))
    return ingest.keep_transcripts(seen, it.select("platform", "source_id", (_id() % 2 == 0).alias("has_transcript"))).select("platform", "source_id", "subtitle_status")


def folded_observations(spark, sf):
    """The last detail and subtitle of each page that a session saw, by arrival."""
    e = events(spark, sf).select(F.col("user_id").alias("session_id"), (F.col("event_id") % 20).cast("string").alias("id"), F.when(F.col("event_type") == "click", "detail").when(F.col("event_type") == "view", "subtitle").otherwise("entry").alias("kind"), F.col("event_id").alias("arrival"), F.col("event_id").cast("string").alias("payload"))
    return ingest.fold_observations(e)


DIMENSIONS = ("accuracy", "coverage", "citation", "synthesis", "clarity", "restraint")


def answer_set(spark, sf):
    """Labels as scored answers, by source of the document: six dimensions, claims covered, hard failures."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic").distinct()
    parts = []
    for toxic in (0, 1):
        marks = F.create_map(*[x for k, name in enumerate(DIMENSIONS[: 6 - toxic]) for x in (F.lit(name), (F.lit(3.0) + (_id() + k) % 3).cast("double"))])
        scores = d.where(F.col("toxic") == toxic).select(F.col("doc_id").alias("question"), marks.alias("dimensions"), (_id() % 20 + 19).alias("covered"), (_id() % 20 + 20).alias("claims"), (F.lit(toxic) == 1).alias("hard_failure"))
        parts.append(maintenance.rubric(scores, len(DIMENSIONS)).withColumn("set", F.lit(toxic)))
    r = parts[0].unionByName(parts[1])
    return r.select("set", F.round("lowest", 6).alias("lowest"), "dimensions", F.round("coverage", 6).alias("coverage"), "hard_failures", "passed")


def budgets(spark, sf):
    """Turns of each conversation cut to 300 characters in all."""
    c = maintenance.content_budget(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], 300)
    return c.select("conv_id", "turn", F.length("text").cast("long").alias("kept"), "truncated")


QUERIES = {
    f.__name__: f
    for f in (
        capped_batches, searchable_chunks, current_vectors, embedding_state, segment_differences, scope_changes, scope_finish, frontier_cut, run_transitions, enqueued, superseded, enrichment_results,
        transcripts_kept, folded_observations, answer_set, budgets,
    )
}


def sql(i: str) -> dict[str, str]:
    """SQL of the queries, from the common table expression of the items."""
    sid = "CAST(doc_id AS VARCHAR)"
    lib = f"{i}, lib AS (SELECT doc_id, platform, access_status = 'available' AND doc_id % 6 <> 0 AND doc_id % 7 <> 0 AS ok, doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS embedded FROM items)"
    good = "coalesce(len(embedding) = 64 AND abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 1e-5, false)"
    return {
        "capped_batches": f"""WITH {i}, c AS (SELECT doc_id, platform, published, doc_id // 20 AS k, row_number() OVER (PARTITION BY platform ORDER BY doc_id) AS n FROM items JOIN documents USING (doc_id) WHERE text IS NOT NULL)
          SELECT platform, CAST(k AS VARCHAR) AS key, count(*) FILTER (WHERE n <= {CAP}) AS scanned, count(*) FILTER (WHERE n <= {CAP} AND published >= 1704100000 AND doc_id % 3 <> 0) AS added, count(*) FILTER (WHERE n <= {CAP} AND published >= 1704100000 AND doc_id % 3 = 0) AS refreshed,
            CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (WHERE n <= {CAP} AND published < 1704100000) AS out_of_range, bool_or(n > {CAP}) AS truncated FROM c GROUP BY platform, k""",
        "searchable_chunks": f"WITH {lib} SELECT doc_id, platform FROM lib WHERE ok",
        "current_vectors": f"WITH {lib} SELECT {sid} AS chunk_id, platform, {good} AS valid FROM lib JOIN embeddings ON vec_id = doc_id WHERE ok AND embedded",
        "embedding_state": f"""WITH {lib}, a AS (SELECT count(*) FILTER (WHERE ok) AS current, count(*) FILTER (WHERE ok AND {good}) AS embedded, count(*) FILTER (WHERE ok AND vec_id IS NOT NULL AND NOT {good}) AS corrupt, CAST(0 AS BIGINT) AS pending, count(*) FILTER (WHERE doc_id % 11 = 0) AS failed
          FROM lib LEFT JOIN embeddings ON vec_id = doc_id) SELECT *, CASE WHEN corrupt > 0 OR failed > 0 THEN 'degraded' WHEN embedded < current THEN 'partial' ELSE 'ready' END AS state FROM a""",
        "segment_differences": f"""WITH s AS (SELECT doc_id, unnest(range(0, length(coalesce(text, '')) // 1000 + 1)) AS i FROM documents)
          SELECT {sid} AS chunk_id, i * 1000 AS begin, i * 1000 + 1000 AS finish, 'missing' AS fault FROM s WHERE (doc_id + i) % 9 = 0 OR (doc_id + i) % 10 = 0
          UNION ALL SELECT {sid}, i * 1000, i * 1000 + 1001, 'extra' FROM s WHERE (doc_id + i) % 9 <> 0 AND (doc_id + i) % 10 = 0""",
        "scope_changes": f"""WITH {i} SELECT platform, {sid} AS scope_id, CASE WHEN doc_id % 7 = 0 THEN 'dropped' WHEN doc_id % 5 = 0 THEN CASE WHEN platform = 'x' THEN 'late' ELSE 'added' END WHEN doc_id % 3 = 0 THEN 'renamed' ELSE 'kept' END AS change
          FROM items WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0""",
        "scope_finish": f"""WITH d AS (SELECT doc_id, doc_id % 9 <> 0 AS live, doc_id % 4 <> 0 AS told, doc_id % 3 <> 0 AS had, doc_id % 2 = 0 AS complete FROM documents)
          SELECT {sid} AS scope_id, CASE WHEN NOT live THEN 'failed' WHEN told THEN 'completed' ELSE 'partial' END AS status, CAST(CASE WHEN live AND told THEN CASE WHEN had AND NOT complete THEN 20 ELSE 15 END WHEN had THEN 20 END AS BIGINT) AS n,
            doc_id || CASE WHEN live AND told THEN '-1' WHEN had THEN '-11' END AS first, doc_id || CASE WHEN live AND told THEN CASE WHEN had AND NOT complete THEN '-20' ELSE '-15' END WHEN had THEN '-30' END AS last FROM d""",
        "frontier_cut": """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id DESC) - 1 AS pos FROM events),
          s AS (SELECT user_id, min(pos) AS stop FROM e WHERE event_id % 13 = 0 AND user_id % 4 <> 0 GROUP BY user_id)
          SELECT CAST(user_id AS VARCHAR) AS platform, count(*) FILTER (WHERE stop IS NULL OR pos < stop) AS n_before, count(*) FILTER (WHERE stop IS NULL OR pos <= stop) AS n_with, count(*) FILTER (WHERE stop IS NULL OR pos // 10 <= stop // 10) AS n_page
          FROM e LEFT JOIN s USING (user_id) GROUP BY user_id""",
        "run_transitions": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, CASE event_type WHEN 'error' THEN 'paused' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'failed' END END END AS s
            FROM events WHERE event_id % 5 = 0),
          f AS (SELECT user_id, first(s ORDER BY sec, event_id) FILTER (WHERE s IN ('completed', 'failed')) AS ended, last(s ORDER BY sec, event_id) FILTER (WHERE s IS NOT NULL) AS l FROM e GROUP BY user_id)
          SELECT user_id, coalesce(ended, l, 'running') AS status FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f USING (user_id)""",
        "enqueued": f"""WITH {i} SELECT platform, {sid} AS source_id, sha256('task' || chr(0) || platform || chr(0) || doc_id || chr(0) || 'summarize' || chr(0) || sha256(coalesce(text, ''))) AS task_id, 'pending' AS status FROM items JOIN documents USING (doc_id) WHERE doc_id % 4 = 0 OR doc_id % 10 = 1""",
        "superseded": f"""WITH {i} SELECT platform, {sid} AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'index_content' ELSE 'summarize' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 'running' WHEN doc_id % 5 <> 0 AND (doc_id % 6 = 0 OR access_status <> 'available') THEN 'completed' ELSE 'pending' END AS status FROM items""",
        "enrichment_results": f"WITH {i} SELECT platform, {sid} AS source_id, CASE WHEN doc_id % 8 = 0 THEN 'stale' ELSE 'applied' END AS result, doc_id % 3 = 0 OR doc_id % 2 = 0 AS again FROM items",
        "transcripts_kept": f"WITH {i} SELECT platform, {sid} AS source_id, ['wrong_video', 'available', 'unavailable'][doc_id % 3 + 1] AS subtitle_status FROM items WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0",
        "folded_observations": """SELECT user_id AS session_id, CAST(event_id % 20 AS VARCHAR) AS id, CAST(max(event_id) FILTER (WHERE event_type NOT IN ('click', 'view')) AS VARCHAR) AS entry,
          CAST(max(event_id) FILTER (WHERE event_type = 'click') AS VARCHAR) AS detail, CAST(max(event_id) FILTER (WHERE event_type = 'view') AS VARCHAR) AS subtitle FROM events GROUP BY 1, 2""",
        "answer_set": """WITH d AS (SELECT DISTINCT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)), k AS (SELECT toxic, k, avg(3.0e0 + (doc_id + k) % 3) AS m FROM d, range(6) r(k) WHERE k < 6 - toxic GROUP BY ALL),
          a AS (SELECT toxic, round(min(m), 6) AS lowest, count(*) AS dimensions FROM k GROUP BY toxic), c AS (SELECT toxic, round(sum(doc_id % 20 + 19) / CAST(sum(doc_id % 20 + 20) AS DOUBLE), 6) AS coverage, count(*) FILTER (WHERE toxic = 1) AS hard_failures FROM d GROUP BY toxic)
          SELECT toxic AS set, lowest, dimensions, coverage, hard_failures, dimensions = 6 AND lowest >= 3 AND coverage >= 0.9 AND hard_failures = 0 AS passed FROM a JOIN c USING (toxic)""",
        "budgets": """WITH w AS (SELECT conv_id, turn, length(text) AS n, greatest(0, 300 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM conversations)
          SELECT conv_id, turn, CAST(least(n, room) AS BIGINT) AS kept, n > room AS truncated FROM w""",
    }
