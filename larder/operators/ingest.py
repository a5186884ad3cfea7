"""Batch ingest with receipts, frontiers, scopes and run states. State tables go in, their changes come out as DataFrames."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.hashes import batch_fingerprint, batch_item, content_hash

# Run states.
TERMINAL = ("completed", "partial", "failed")
FRONTIER = 20
RUN, BATCH, ITEM = ["job_id", "platform"], ["job_id", "platform", "key"], ["platform", "source_id"]
CAME, ORDER = [*BATCH, "arrival"], ["arrival", "job_id", "key", "pos"]


def access_status(status: Column) -> Column:
    """What a source status says of the item: there, gone, or nothing (a passing failure never flips it)."""
    return F.when(status == "available", "available").when(status == "source_unavailable", "unavailable")


def arrived(rows: DataFrame) -> DataFrame:
    """``rows`` with ``arrival``, the order in which their batches came. Without that column, keys that are numbers go by number, and others after them by text."""
    if "arrival" in rows.columns:
        return rows.withColumn("arrival", F.col("arrival").cast("long"))
    return rows.withColumn("arrival", F.coalesce(F.col("key").try_cast("long"), F.lit(2**62)))


def batches(rows: DataFrame) -> DataFrame:
    """(job, platform, key, arrival, fingerprint, size) of each batch that came: its items' canonical JSON in order of ``pos``. A batch is a request of bounded size."""
    got = arrived(rows).select(*CAME, F.struct("pos", batch_item().alias("json")).alias("i")).groupBy(*CAME).agg(F.array_sort(F.collect_list("i")).alias("i"))
    return got.select(*CAME, batch_fingerprint(F.transform("i", lambda x: x["json"])).alias("fingerprint"), F.size("i").cast("long").alias("size"))


def admit(rows: DataFrame, receipts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each batch that came with its ``verdict`` and what ``runs`` says of its run.

    replay: the key is known with the same fingerprint, so the stored receipt stands. conflict: it is known with another payload.
    unknown: no such run. terminal: the run has ended. accept: all others. A key is known from a receipt, or from an earlier arrival in this call. ``before`` counts the
    rows of accepted batches of the run that came ahead of it; batches that came together go by key.
    """
    old = receipts.select(*BATCH, F.col("fingerprint").alias("_known"))
    b = batches(rows).join(old, BATCH, "left").join(runs, RUN, "left")
    open_ = F.col("status").isNotNull() & ~F.col("status").isin(*TERMINAL)
    first = F.first("fingerprint").over(Window.partitionBy(*BATCH).orderBy("arrival"))
    again = F.row_number().over(Window.partitionBy(*BATCH).orderBy("arrival")) > 1
    b = b.withColumn("_known", F.coalesce("_known", F.when(open_ & again, first)))
    known = F.col("_known").isNotNull()
    verdict = F.when(known & (F.col("_known") == F.col("fingerprint")), "replay").when(known, "conflict").when(F.col("status").isNull(), "unknown").when(F.col("status").isin(*TERMINAL), "terminal")
    b = b.withColumn("verdict", verdict.otherwise("accept")).drop("_known")
    w = Window.partitionBy(*RUN).orderBy("arrival", "key").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("before", F.coalesce(F.sum(F.when(F.col("verdict") == "accept", F.col("size"))).over(w), F.lit(0)))


def submit(rows: DataFrame, receipts: DataFrame, runs: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
    """Ingest batches of captured items.

    ``rows``: job_id, platform, key, pos (from 0) and the item columns, with source_status and favorited_at, and arrival where it is known (see ``arrived``). ``runs``: job_id, platform, status,
    mode, scanned, cap, since, until. ``state``: platform, source_id, content_hash, published_at, first_seen_at, favorited_at, access_status.
    Out come ``verdicts`` of all batches; ``receipts`` of the accepted ones (scanned, added, refreshed, duplicates, out_of_range, truncated);
    ``items``, the rows of state that are new or changed; and ``changes``, each accepted row with its ``change``. A cap lets the first rows of a run in, in
    order of arrival and position; rows out of range are counted and not dropped silently. Replays change nothing. Of several sights of an item the last to arrive stands.
    """
    verdicts = admit(rows, receipts, runs)
    ok = verdicts.where("verdict = 'accept'").drop("status", "verdict")
    at = F.col("before") + F.col("pos") + F.coalesce("scanned", F.lit(0))
    r = arrived(rows).withColumn("content_hash", content_hash()).join(ok, CAME).withColumn("scanned_in", F.coalesce(at < F.col("cap"), F.lit(True)))
    inside = F.coalesce(F.col("published_at") >= F.col("since"), F.lit(True)) & F.coalesce(F.col("published_at") <= F.col("until"), F.lit(True))
    r = r.withColumn("taken", F.col("scanned_in") & inside)
    old = state.select(*ITEM, *[F.col(c).alias(f"_{c}") for c in ("content_hash", "published_at", "access_status", "first_seen_at", "favorited_at")])
    t = r.where("taken").join(old, ITEM, "left")
    # A second sight of an item in these batches is compared with the first.
    w = Window.partitionBy(*ITEM).orderBy(*ORDER)
    seen = F.row_number().over(w) > 1
    was = F.when(seen, F.lag("content_hash").over(w)).otherwise(F.col("_content_hash"))
    same = (was == F.col("content_hash")) & F.when(seen, F.lit(True)).otherwise((F.col("_published_at") == F.col("published_at")) & (F.col("_access_status") == "available"))
    change = F.when(~seen & F.col("_content_hash").isNull(), "added").when((F.col("mode") != "full") | F.coalesce(same, F.lit(False)), "duplicate").otherwise("refreshed")
    t = t.withColumn("change", change)
    both = r.join(t.select(*BATCH, "pos", "change"), [*BATCH, "pos"], "left")
    count = lambda c, n: F.count_if(c).alias(n)
    made = both.groupBy(*BATCH, "fingerprint").agg(
        count(F.col("scanned_in"), "scanned"), *[count(F.col("change") == k, n) for k, n in (("added", "added"), ("refreshed", "refreshed"), ("duplicate", "duplicates"))],
        count(F.col("scanned_in") & ~F.col("taken"), "out_of_range"), F.bool_or(~F.col("scanned_in")).alias("truncated"),
    )
    last = F.max_by(F.struct("content_hash", "published_at"), F.struct(*ORDER))
    told = F.max_by(access_status(F.col("source_status")), F.when(access_status(F.col("source_status")).isNotNull(), F.struct(*ORDER)))
    items = t.where("change <> 'duplicate'").groupBy(*ITEM).agg(
        last.alias("l"), F.coalesce(F.first("_first_seen_at"), F.min("observed_at")).alias("first_seen_at"), F.least(F.first("_favorited_at"), F.min("favorited_at")).alias("favorited_at"),
        F.coalesce(told, F.first("_access_status"), F.lit("available")).alias("access_status"),
    )
    items = items.select(*ITEM, "l.content_hash", "l.published_at", "first_seen_at", "favorited_at", "access_status")
    return {"verdicts": verdicts, "receipts": made, "items": items, "changes": t.drop(*[c for c in t.columns if c.startswith("_")])}


def upsert(state: DataFrame, changed: DataFrame, keys=tuple(ITEM)) -> DataFrame:
    """State after ``changed`` replaced or added rows."""
    return state.join(changed.select(*keys), list(keys), "left_anti").unionByName(changed.select(*state.columns))


def replace_rows(stored: DataFrame, fresh: DataFrame, touched: DataFrame, keys=tuple(ITEM)) -> DataFrame:
    """Chunks or vectors after all rows of the ``touched`` items were replaced by ``fresh``; an item without fresh rows loses its old ones."""
    return stored.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh.select(*stored.columns))


def start(requests: DataFrame, frontiers: DataFrame) -> DataFrame:
    """One running run per platform of each job; incremental jobs are handed the stored frontier, full jobs none."""
    runs = requests.select("job_id", "mode", "cap", "since", "until", F.explode("platforms").alias("platform"))
    none = F.array().cast("array<string>")
    runs = runs.join(frontiers.select("platform", F.col("ids").alias("_ids")), "platform", "left")
    return runs.withColumn("frontier", F.when(F.col("mode") == "incremental", F.coalesce("_ids", none)).otherwise(none)).withColumn("status", F.lit("running")).withColumn("scanned", F.lit(0).cast("long")).drop("_ids")


def bounded_frontier(new: Column, old: Column) -> Column:
    """New ids, then old ones, distinct in order, the first 20."""
    return F.slice(F.array_distinct(F.concat(new, F.coalesce(old, F.array().cast("array<string>")))), 1, FRONTIER)


def finish(runs: DataFrame, results: DataFrame, frontiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, frontiers) after scans ended. ``results``: job_id, platform, observed_end, cap_reached, ids, and ended where the time is known.

    A scan that saw the end without a cap completes its run and moves the frontier (incremental: new before old; full: replaced);
    any other is partial and leaves it. Runs that have ended stay as they are, so a repeated finish changes nothing. Runs of a platform that end in one call move its frontier one after the other, by ``ended`` and job.
    """
    r = runs.join(results, RUN, "left")
    live = F.col("observed_end").isNotNull() & ~F.col("status").isin(*TERMINAL)
    done = live & F.col("observed_end") & ~F.col("cap_reached") & ~F.coalesce("truncated", F.lit(False))
    r = r.withColumn("_done", done).withColumn("status", F.when(done, "completed").when(live, "partial").otherwise(F.col("status")))
    ended = F.col("ended") if "ended" in results.columns else F.lit(None).cast("timestamp")
    step = F.struct(ended.alias("ended"), "job_id", "mode", "ids")
    moved = r.where("_done").groupBy("platform").agg(F.array_sort(F.collect_list(step)).alias("_steps"))  # the runs that end now
    moved = moved.join(frontiers.select("platform", F.col("ids").alias("_old")), "platform", "left")
    none = F.array().cast("array<string>")
    fold = F.aggregate("_steps", F.coalesce("_old", none), lambda old, x: bounded_frontier(x["ids"], F.when(x["mode"] == "incremental", old)))
    return r.select(*runs.columns), upsert(frontiers, moved.select("platform", fold.alias("ids")), ("platform",))


def finish_scopes(scope_runs: DataFrame, reported: DataFrame, frontiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope runs, scope frontiers): reported scopes (job_id, platform, scope_id, ids) complete and advance, other open ones are partial."""
    keys = [*RUN, "scope_id"]
    r = scope_runs.join(reported.select(*keys, "ids"), keys, "left")
    live = ~F.col("status").isin(*TERMINAL)
    moved = r.where(live & F.col("ids").isNotNull()).join(frontiers.select("platform", "scope_id", F.col("ids").alias("_old")), ["platform", "scope_id"], "left")
    moved = moved.select("platform", "scope_id", bounded_frontier(F.col("ids"), F.when(F.col("mode") == "incremental", F.col("_old"))).alias("ids"))
    r = r.withColumn("status", F.when(live, F.when(F.col("ids").isNotNull(), "completed").otherwise("partial")).otherwise(F.col("status")))
    return r.select(*scope_runs.columns), upsert(frontiers, moved, ("platform", "scope_id"))


def apply_scope_results(scope_runs: DataFrame, results: DataFrame) -> DataFrame:
    """Scope runs after results (job_id, platform, scope_id, cap_reached, visible_total, at); of several for a scope the last by ``at`` stands, and nulls stay as they were."""
    keys = [*RUN, "scope_id"]
    last = results.groupBy(*keys).agg(F.max_by(F.struct("cap_reached", "visible_total"), F.struct("at", "cap_reached", "visible_total")).alias("_r"))
    r = scope_runs.join(last, keys, "left")
    new = {c: F.coalesce(F.col(f"_r.{c}"), F.col(c)) for c in ("cap_reached", "visible_total")}
    return r.select(*[new.get(c, F.col(c)).alias(c) for c in scope_runs.columns])


def unknown_results(scope_runs: DataFrame, results: DataFrame) -> DataFrame:
    """Results for scopes that no run has, which are errors."""
    keys = [*RUN, "scope_id"]
    return results.join(scope_runs.select(*keys), keys, "left_anti")


def run_status(runs: DataFrame, scope_runs: DataFrame, batches_: DataFrame) -> DataFrame:
    """One row a run: its status and counters, and its scopes in order of their id.

    ``batches_`` (job_id, platform, scope_id, scanned, added, refreshed, duplicates, out_of_range) are receipts, with a null scope on flat platforms; counters that are absent are 0. A scope is (scope_id, name, status, scanned,
    cap_reached, visible_total); the scopes of a run are its folders, and few.
    """
    names = ("scanned", "added", "refreshed", "duplicates", "out_of_range")
    total = batches_.groupBy(*RUN).agg(*[F.sum(c).alias(c) for c in names])
    by_scope = batches_.where(F.col("scope_id").isNotNull()).groupBy(*RUN, "scope_id").agg(F.sum("scanned").alias("_scanned"))
    s = scope_runs.join(by_scope, [*RUN, "scope_id"], "left").withColumn("scanned", F.coalesce("_scanned", F.lit(0)).cast("long"))
    one = F.struct("scope_id", "name", "status", "scanned", "cap_reached", "visible_total")
    listed = s.groupBy(*RUN).agg(F.array_sort(F.collect_list(one)).alias("scopes"))
    out = runs.select(*RUN, "status").join(total, RUN, "left").join(listed, RUN, "left")
    return out.select(*RUN, "status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], "scopes")


def shown_embedding_state(state: Column, profile: Column, cached: Column, corrupt: Column) -> Column:
    """The state of embeddings as a status shows it: disabled without a profile, unavailable where the model is not held, degraded where a search met corrupt vectors, else ``state``."""
    return F.when(profile.isNull(), "disabled").when(~F.coalesce(cached, F.lit(False)), "unavailable").when(corrupt > 0, "degraded").otherwise(state)


def register_scopes(known: DataFrame, declared: DataFrame, scanned: DataFrame) -> DataFrame:
    """Each scope of a run as kept, added, dropped (an error), renamed (an error) or late (added after scanning began, an error); (job_id, platform, scope_id, name)."""
    keys = [*RUN, "scope_id"]
    both = known.select(*keys, F.col("name").alias("_k")).join(declared.select(*keys, F.col("name").alias("_d")), keys, "full").join(scanned.select(*RUN, "scanned"), RUN, "left")
    return both.select(*keys, F.when(F.col("_d").isNull(), "dropped").when(F.col("_k").isNull(), F.when(F.coalesce("scanned", F.lit(0)) > 0, "late").otherwise("added")).when(F.col("_k") != F.col("_d"), "renamed").otherwise("kept").alias("change"))


def apply_transitions(runs: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each run after its events (keys, at, event: pause, resume, fail, complete, expire) in order. Ended runs do not change; odd events leave the state."""
    step = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("_e"))  # a run's own control events

    def move(s, x):
        e = x["event"]
        rule = F.when(s.isin(*TERMINAL), s).when(e == "fail", "failed").when(e == "complete", "completed").when((s == "running") & e.isin("pause", "expire"), "paused").when((s == "paused") & (e == "resume"), "running")
        return rule.otherwise(s)

    r = runs.join(step, keys, "left")
    return r.withColumn("status", F.when(F.col("_e").isNull(), F.col("status")).otherwise(F.aggregate("_e", F.col("status"), move))).drop("_e")


def expire_sessions(sessions: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """Open sessions whose lease has run out are paused; ``renewed`` is the time of the last heartbeat."""
    over = F.col("status").isin("running", "claimed") & (F.col("renewed") + F.make_dt_interval(secs=F.lit(seconds)) <= now)
    return sessions.withColumn("status", F.when(over, "paused").otherwise(F.col("status")))


def open_session_conflicts(sessions: DataFrame) -> DataFrame:
    """Platforms with more than one open session."""
    return sessions.where(~F.col("status").isin(*TERMINAL, "cancelled")).groupBy("platform").agg(F.count("*").alias("open")).where("open > 1")


def unknown_scopes(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """Events of scopes that their run has not registered."""
    return events.where(F.col("scope_id").isNotNull()).join(scopes.select(*RUN, "scope_id"), [*RUN, "scope_id"], "left_anti")


def cut_at_frontier(rows: DataFrame, frontier: DataFrame, mode: str = "before") -> DataFrame:
    """Rows of a newest-first scan (job_id, platform, page, pos, source_id) up to the first known id.

    ``before`` stops ahead of it, ``with`` keeps it too, ``page`` keeps the whole page that holds it.
    """
    known = frontier.select(*RUN, F.explode("ids").alias("source_id"))
    hit = rows.join(known, [*RUN, "source_id"], "left_semi").groupBy(*RUN).agg(F.min("pos").alias("_stop"), F.min_by("page", "pos").alias("_page"))
    r = rows.join(F.broadcast(hit), RUN, "left")  # one row a run, which all rows of a platform would meet in one task
    rule = {"before": F.col("pos") < F.col("_stop"), "with": F.col("pos") <= F.col("_stop"), "page": F.col("page") <= F.col("_page")}[mode]
    return r.where(F.coalesce(rule, F.lit(True))).drop("_stop", "_page")


def fold_observations(events: DataFrame) -> DataFrame:
    """The last detail and subtitle of each id within a session (session_id, id, kind, arrival, payload)."""
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("payload")), F.when(F.col("kind") == k, F.col("arrival"))).alias(k)
    return events.groupBy("session_id", "id").agg(*[last(k) for k in ("entry", "detail", "subtitle")])


def keep_transcripts(captured: DataFrame, stored: DataFrame) -> DataFrame:
    """Captures whose transcript was refused as another video's lose nothing: such rows for items that hold a transcript are left out."""
    held = stored.where("has_transcript").select(*ITEM, F.lit(True).alias("_held"))
    return captured.join(held, ITEM, "left").where(~((F.col("subtitle_status") == "wrong_video") & F.coalesce("_held", F.lit(False)))).drop("_held")
