"""Structured Streaming: batches of captured items from a file stream into append-only state logs, and leases as session windows.

A micro-batch overwrites its own partition of each log, so a replay after a lost driver or executor changes nothing; state is
the last row of each key over the partitions before it.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import ingest

ROWS = """job_id string, platform string, key string, pos int, source_id string, canonical_url string, title string, author string, published_at timestamp,
observed_at timestamp, body string, collections array<string>, extractor_version string, source_status string, favorited_at timestamp"""
STATE = "platform string, source_id string, content_hash string, published_at timestamp, first_seen_at timestamp, favorited_at timestamp, access_status string"
RECEIPT = "job_id string, platform string, key string, fingerprint string, scanned long, added long, refreshed long, duplicates long, out_of_range long, truncated boolean"


def read_log(spark: SparkSession, path: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The last row of each key in a log, over all partitions or those before ``before``: from the newest base that covers no more, and the partitions since."""
    marks = spark.read.schema("upto long").parquet(f"{path}_marks")
    upto = (marks if before is None else marks.where(F.col("upto") <= before)).agg(F.max("upto")).first()[0]
    log = spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") >= upto)
    log = log if before is None else log.where(F.col("batch") < before)
    if upto >= 0:
        log = log.unionByName(spark.read.schema(schema).parquet(f"{path}_base/upto={upto}").withColumn("batch", F.lit(upto - 1)))
    names = [c for c in log.columns if c not in (*keys, "batch")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_r"))
    return last.select(*keys, "_r.*").select(*[c for c in log.columns if c != "batch"])


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], batch: int) -> None:
    """Write the state before ``batch`` as a base, and then the mark that lets readers use it; a run that was lost between them is repeated in place."""
    read_log(spark, path, schema, keys, batch).write.mode("overwrite").parquet(f"{path}_base/upto={batch}")
    spark.createDataFrame([(batch,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}_marks")


def _append(rows: DataFrame, path: str, batch: int) -> None:
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def by_file(rows: DataFrame) -> DataFrame:
    """Rows of a micro-batch with the arrival of their file: by time of change, then path, one number a file. A row that a file holds twice counts once."""
    files = rows.select("_file", "_time").distinct()  # no more than a trigger takes
    number = files.withColumn("arrival", F.row_number().over(Window.orderBy("_time", "_file")).cast("long")).drop("_time")
    return rows.drop("_time").join(F.broadcast(number), "_file").drop("_file").dropDuplicates([*ingest.CAME, "pos"])


def ingest_stream(spark: SparkSession, source: str, root: str, runs: DataFrame, checkpoint: str, files: int = 100, every: int = 20) -> StreamingQuery:
    """Start ingest of JSON files (``ROWS``) under ``source``; logs go to ``root``/items and ``root``/receipts. ``runs`` as in ``ingest.submit``; all available files, then it stops.

    A file holds whole batches. Files of a micro-batch arrive by time of change: of two with one key the first is taken and the other is its replay, or a conflict. Every ``every`` micro-batches the logs get a base, so a
    micro-batch reads no more than that many partitions however long the stream has run.
    """
    logs = (("items", STATE, ingest.ITEM), ("receipts", RECEIPT, ingest.BATCH))
    for name, schema, _ in logs:
        _append(spark.createDataFrame([], schema), f"{root}/{name}", -1)
        spark.createDataFrame([], f"{schema}").write.mode("append").parquet(f"{root}/{name}/batch=-1")
        spark.createDataFrame([(-1,)], "upto long").coalesce(1).write.mode("append").parquet(f"{root}/{name}_marks")

    def each(rows: DataFrame, batch: int) -> None:
        if batch and batch % every == 0:
            for name, schema, keys in logs:
                compact(spark, f"{root}/{name}", schema, keys, batch)
        state = read_log(spark, f"{root}/items", STATE, ingest.ITEM, batch)
        receipts = read_log(spark, f"{root}/receipts", RECEIPT, ingest.BATCH, batch)
        scanned = receipts.groupBy(*ingest.RUN).agg(F.sum("scanned").alias("scanned"))
        out = ingest.submit(by_file(rows), receipts, runs.drop("scanned").join(scanned, ingest.RUN, "left"), state)
        _append(out["items"], f"{root}/items", batch)
        _append(out["receipts"], f"{root}/receipts", batch)

    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).json(source)
    stream = stream.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"))
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lease_stream(beats: DataFrame, at: str = "at", by: str = "session_id", seconds: int = 180, late: str = "10 minutes") -> DataFrame:
    """Leases of a stream of heartbeats: one row per session window, which ends a lease after its last heartbeat. Heartbeats later than ``late`` are dropped."""
    w = F.session_window(at, f"{seconds} seconds")
    got = beats.withWatermark(at, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("beats"))
    return got.select(by, F.col("w.start").alias("begun"), F.col("w.end").alias("expires"), "beats")
