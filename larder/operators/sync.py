"""Incremental scans: caps, batch numbers, publication ranges, frontiers, leases."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, same).drop(*[f"_r_{k}" for k in keys])


def _before(slices: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier slices of each scope: one small row per slice."""
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def number_batches(events: DataFrame, by: list[str], order: list[str], cap: int, size: int = 20, span: int = 86400) -> DataFrame:
    """Scan position, batch number and whether the scan cap lets the row in.

    Rows are numbered within a scope and a slice of ``span`` of the first order column (a number), and slices are offset by the counts of those
    before, so no scope is sorted in one task.
    """
    e = events.withColumn("_slice", F.floor(F.col(order[0]) / span))
    n = _before(e.groupBy(*by, "_slice").agg(F.count("*").alias("_n")), by, "_n", "_off").drop("_n")
    e = _beside(e.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order))), n, [*by, "_slice"])
    e = e.withColumn("pos", F.col("_off") + F.col("_i")).drop("_slice", "_off", "_i")
    return e.withColumn("batch", F.floor((F.col("pos") - 1) / size)).withColumn("accepted", F.col("pos") <= cap)


def frontier(events: DataFrame, by: list[str], order: str, key: str, most: int = 20) -> DataFrame:
    """The ``most`` newest distinct ids of each scope, newest first."""
    last = events.groupBy(*by, key).agg(F.max(order).alias("_at"))
    w = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col(key).desc())
    return last.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).drop("_at")


def leases(events: DataFrame, by: str, at: str, seconds: int = 180, span: int = 86400) -> DataFrame:
    """Sessions of events no more than a lease apart, by the gap to the event before.

    A scope's events are walked in slices of ``span`` seconds; the last event and the sessions begun before are carried into each slice.
    """
    e = events.withColumn("_slice", F.floor(F.col(at) / span))
    ends = e.groupBy(by, "_slice").agg(F.max(at).alias("_last"))
    ends = ends.withColumn("_prev", F.lag("_last").over(Window.partitionBy(by).orderBy("_slice"))).drop("_last")
    e = _beside(e, ends, [by, "_slice"])
    w = Window.partitionBy(by, "_slice").orderBy(at)
    gap = F.col(at) - F.coalesce(F.lag(at).over(w), F.col("_prev"))
    e = e.withColumn("_new", F.when(gap <= seconds, 0).otherwise(1))
    n = _before(e.groupBy(by, "_slice").agg(F.sum("_new").alias("_n")), [by], "_n", "_off").drop("_n")
    e = _beside(e.withColumn("_s", F.sum("_new").over(w)), n, [by, "_slice"]).withColumn("session", F.col("_off") + F.col("_s"))
    return e.groupBy(by, "session").agg(F.min(at).alias("begun"), F.max(at).alias("ended"), F.count("*").alias("beats"))


def batch_counters(rows: DataFrame, by: list[str], change: str, in_range) -> DataFrame:
    """Counts of each batch and the rows scanned up to its end; rows outside the range count as such only."""
    kinds = ("added", "refreshed", "duplicate")
    ok = F.coalesce(in_range, F.lit(False))
    counts = [F.count_if(ok & (F.col(change) == k)).alias(k) for k in kinds]
    got = rows.groupBy(*by, "batch").agg(F.count("*").alias("scanned"), *counts, F.count_if(~ok).alias("out_of_range"))
    return got.withColumn("scanned_so_far", F.sum("scanned").over(Window.partitionBy(*by).orderBy("batch")))


def latest(runs: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Value of the last run of each scope."""
    return runs.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def job_rollup(runs: DataFrame, job: str, status: str = "status") -> DataFrame:
    """Job status from its runs: failed, then partial or completed once all have ended, then paused, then running."""
    has = lambda s: F.bool_or(F.col(status) == s)
    ended = F.bool_and(F.col(status).isin("completed", "partial", "failed"))
    rule = F.when(has("failed"), "failed").when(ended & has("partial"), "partial").when(ended, "completed").when(has("paused"), "paused")
    return runs.groupBy(job).agg(rule.otherwise("running").alias(status))


def claim(tasks: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` pending tasks of each lane, oldest first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return tasks.where("status = 'pending'").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
