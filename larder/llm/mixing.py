"""Sainte-Laguë mixing: integer block quotas per source and shard, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, cut, table

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, docs, source_size, target) from (source, docs, source_size), one row per source.

    Sources sort by code point, null last, and take the weights in turn. Caps bind in order of
    cap / weight, so the level of the water is found with two running sums over the sources.
    The window holds one small row per source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    arr = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.element_at(arr, (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = s.withColumn("_all", share * F.sum("source_size").over(total))
    s = s.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # Past the first source below its cap the level stays: take it there.
    s = s.withColumn("_final", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(total)["_level"])
    free = (F.col("_ratio") > F.col("_level")) & F.col("_final").isNotNull()
    return s.withColumn("target", F.when(free, F.col("_w") * F.col("_final")).otherwise(F.col("_cap"))).select("source", "docs", "source_size", "target")


def sainte_lague(cells: DataFrame, group: list[str], key: Column, want: Column, seats: Column) -> DataFrame:
    """Add ``quota``: ``seats`` of each group shared over its cells by the highest quotients want / (2a + 1).

    Rounding want at the mean divisor gives all but a few seats; the rest are single quotients
    above or below that, ranked. Ties go to the smaller key. No step loops over seats.
    """
    w = Window.partitionBy(*group)
    c = cells.withColumn("_want", want).withColumn("_seats", seats).withColumn("_sum", F.sum("_want").over(w))
    c = c.withColumn("_q", F.when(F.col("_sum") > 0, F.col("_want") * F.col("_seats") / F.col("_sum")).otherwise(0.0))
    c = c.withColumn("_base", F.floor(F.col("_q") + 0.5)).withColumn("_gap", F.col("_seats") - F.sum("_base").over(w))
    # Quotients next to the rounding point: a cell gains or loses seats one by one from there.
    # A cell moves at most its share of the gap and of one seat per cell, plus one: rows stay linear.
    c = c.withColumn("_n_cells", F.count("*").over(w))
    share = F.when(F.col("_seats") > 0, F.ceil(F.col("_q") * (F.abs("_gap") + F.col("_n_cells")) / F.col("_seats")) + 1).otherwise(0)
    n = F.least(F.abs("_gap"), share)
    step = F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n)))
    c = c.withColumn("_key", key)
    e = c.withColumn("_i", step)
    a = F.when(F.col("_gap") > 0, F.col("_base") + F.col("_i") - 1).otherwise(F.col("_base") - F.col("_i"))
    e = e.withColumn("_a", a).withColumn("_quot", F.when(F.col("_a") >= 0, F.col("_want") / (2 * F.col("_a") + 1)))
    asc = Window.partitionBy(*group).orderBy(F.when(F.col("_gap") > 0, -F.col("_quot")).otherwise(F.col("_quot")).asc_nulls_last(), F.when(F.col("_gap") > 0, F.col("_key")).asc_nulls_last(), F.col("_key").desc_nulls_first())
    e = e.withColumn("_rank", F.row_number().over(asc))
    moved = F.sum(F.when(F.col("_quot").isNotNull() & (F.col("_rank") <= F.abs("_gap")), F.signum(F.col("_gap").cast("double"))).otherwise(0.0))
    keys = [x for x in cells.columns]
    return e.groupBy(*keys, "_base").agg(moved.alias("_m")).withColumn("quota", (F.col("_base") + F.col("_m")).cast("long")).drop("_base", "_m")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", block: int = 4, shard_docs: int = 2000, seed: int = 17, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, size, source_size, target, taken) per row of ``docs``.

    Size counts words (null text: 0). Sources split into hash shards of about ``shard_docs``
    rows, so a source holding a third of all rows is spread. Each source gets blocks of ``block``
    words by Sainte-Laguë, its shards share them likewise, and a shard takes its blocks
    in seeded order, every block once before any twice. Equal seeds give equal results.
    Repeated rows are separate documents. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    d = cut(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("_r")))
    per = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    t = source_targets(per, share, most)
    t = t.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    t = t.withColumn("_g", F.lit(0))
    t = cut(sainte_lague(t, ["_g"], F.col("source"), F.col("target"), F.col("_seats")).drop("_g", "_seats"))
    t = t.withColumn("_shards", F.ceil(F.col("docs") / shard_docs)).withColumnRenamed("source", "_src")
    d = d.join(F.broadcast(t) if _few(t) else t, d.source.eqNullSafe(t["_src"])).drop("_src", "docs")
    d = d.withColumn("_shard", F.pmod(F.xxhash64(F.col("_r"), F.lit("shard")), F.col("_shards")))
    cells = d.groupBy("source", "_shard", "quota").agg(F.sum("size").alias("_n")).withColumnRenamed("quota", "_sq")
    cells = sainte_lague(cells, ["source"], F.col("_shard"), F.col("_n").cast("double"), F.col("_sq"))
    cells = cells.select(F.col("source").alias("_cs"), F.col("_shard").alias("_ch"), (F.col("quota") * block).alias("_words"), F.col("_n"))
    d = d.drop("quota").join(cells, d.source.eqNullSafe(cells["_cs"]) & (d["_shard"] == cells["_ch"]))
    run = Window.partitionBy("source", "_shard").orderBy("_r", "_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    part = lambda words: F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("_before")))
    taken = part(F.col("_words")) + part(F.col("_words") - F.col("_n"))
    return d.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def _few(t: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources has so few rows that it may be broadcast."""
    return len(t.select("_src").limit(most + 1).collect()) <= most


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
