"""Queries that run a stream over the given tables until all of it is read, and their SQL for DuckDB."""

from pyspark.sql import functions as F

from larder import storage
from larder.sources.binding import table
from larder.streaming import sessions

LEASE = 86400


def timeline(spark, sf):
    """Sessions by user: sign-ups claim, errors pause, other events are items; a claim begins each and a completion ends it, a second before and after."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    kind = F.when(F.col("kind") == "signup", "claim").when(F.col("kind") == "error", "pause").otherwise("item")
    rows = e.select(F.col("user_id").alias("session_id"), F.lit("x").alias("platform"), F.col("event_id").alias("seq"), "at", kind.alias("kind"), F.col("event_id").cast("string").alias("item"))
    ends = rows.groupBy("session_id").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    edge = lambda c, by, name, seq: ends.select("session_id", F.lit("x").alias("platform"), F.lit(seq).cast("long").alias("seq"), (F.col(c) + F.expr(f"interval {by} second")).alias("at"), F.lit(name).alias("kind"), F.lit(None).cast("string").alias("item"))
    return rows.union(edge("low", -1, "claim", -1)).union(edge("high", 1, "complete", 2**62))


def session_flush(spark, sf):
    """Batches that the sessions send, from files in order of time that come in several micro-batches."""
    root = storage.folder(spark, "sessions")
    timeline(spark, sf).repartitionByRange(3, "at").sortWithinPartitions("at").write.parquet(f"{root}/in")
    query = sessions.run(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", LEASE)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    sent = spark.read.schema(sessions.OUT).parquet(f"{root}/out").where("what = 'batch'")
    return sent.select("session_id", "number", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (session_flush,)}


def sql() -> dict[str, str]:
    return {
        "session_flush": f"""WITH e AS (SELECT user_id AS s, event_id AS seq, ts AS tm, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'pause' ELSE 'item' END AS kind FROM events),
          a AS (SELECT * FROM e UNION ALL SELECT s, -1, min(tm) - INTERVAL 1 SECOND, 'claim' FROM e GROUP BY s UNION ALL SELECT s, 4611686018427387904, max(tm) + INTERVAL 1 SECOND, 'complete' FROM e GROUP BY s),
          g AS (SELECT *, coalesce(epoch_us(tm) // 1000 - epoch_us(lag(tm) OVER w) // 1000 >= {LEASE * 1000}, false) AS gone FROM a WINDOW w AS (PARTITION BY s ORDER BY tm, seq)),
          c AS (SELECT *, CASE WHEN kind = 'claim' THEN 1 WHEN kind = 'pause' OR gone THEN 0 END AS ctrl FROM g),
          t AS (SELECT *, last_value(ctrl IGNORE NULLS) OVER (PARTITION BY s ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live FROM c),
          i AS (SELECT s, seq, tm, row_number() OVER (PARTITION BY s ORDER BY tm, seq) - 1 AS k FROM t WHERE kind = 'item' AND live = 1),
          b AS (SELECT s, k // {sessions.BATCH} AS number, count(*) AS n, sha256(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY tm, seq)) AS digest FROM i GROUP BY ALL),
          f AS (SELECT s, live FROM t WHERE kind = 'complete')
          SELECT s AS session_id, number, n, digest FROM b JOIN f USING (s) WHERE n = {sessions.BATCH} OR live = 1""",
    }
