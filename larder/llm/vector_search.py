"""Exact top-k inner product with a vector-approximation file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import cut, table

CELLS = 256  # a cell takes one byte
_LIMIT = 2.0**62


def _edges(batches):
    """Least and largest component of each dimension, by length of the vectors."""
    held: dict[int, tuple] = {}
    for b in batches:
        for w, rows in b.groupby(b["x"].map(len))["x"]:
            x = np.stack(rows.to_list())
            low, high = held.get(w, (x[0], x[0]))
            held[w] = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    for w, (low, high) in held.items():
        yield pd.DataFrame({"w": w, "i": range(w), "low": low, "high": high})


def _pack(make, most: int):
    """mapInPandas: rows (k, id, x) in packed blocks of at most ``most`` rows of one length."""

    def pack(batches):
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for w, rows in b.groupby(b["x"].map(len)):
                for at in range(0, len(rows), most):
                    part = rows.iloc[at : at + most]
                    x = np.stack(part["x"].to_list()).astype(np.int64)
                    ks, ids = (part[c].to_numpy(np.int64).tobytes() for c in ("k", "id"))
                    yield pd.DataFrame({"block": [block], "w": [w], "ks": [ks], "ids": [ids], "x": [make(x, int(w))]})
                    block += 1

    return pack


def _bounds(edges: dict, k: int):
    """mapInPandas over (block of cells, block of queries): rows whose upper bound reaches the block's kth lower bound."""

    def scan(batches):
        for b in batches:
            for r in b.itertuples():
                low, side = edges[r.w]
                cell = np.frombuffer(r.x, np.uint8).reshape(-1, r.w)
                lo = (low + cell * side).astype(float)
                hi = lo + (side - 1)
                q = np.frombuffer(r.q, np.int64).reshape(-1, r.w).astype(float)
                pos, neg = np.maximum(q, 0), np.minimum(q, 0)
                slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T * 2.0**-40  # rounding of the bounds
                up, down = pos @ hi.T + neg @ lo.T + slack, pos @ lo.T + neg @ hi.T - slack
                ids, ks, qids, qks = (np.frombuffer(x, np.int64) for x in (r.ids, r.ks, r.qids, r.qks))
                own = qids[:, None] == ids[None, :]
                down[own], up[own] = -np.inf, -np.inf
                n = min(k, len(ids))
                sure = np.partition(down, len(ids) - n, axis=1)[:, len(ids) - n]
                i, j = np.nonzero((up >= sure[:, None]) & ~own)
                yield pd.DataFrame({"qk": qks[i], "k": ks[j], "up": up[i, j], "down": down[i, j]})

    return scan


def exact_top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec: str = "embedding", scale: int = 1024, k: int = 10, rows: int = 4096, block: int = 512, spread: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product per query, ties to the smaller id.

    Components become floor(scale * x). Null ids, null and empty vectors and vectors with a null or non-finite component
    take no part, nor do candidates whose length differs from the query's. A scaled component of 2^62 or more, and a score that
    does not fit a long, raise an error. A repeated id is a separate candidate and never an answer to itself; each row of a
    repeated query id is a query. Only the named columns are read, so other columns cannot clash. An empty table gives no rows.

    The approximation file is written once: for each dimension 256 cells between its least and largest value, a byte a component, in
    packed blocks of ``rows`` rows. The first pass reads it alone: blocks of rows meet blocks of ``block``
    queries (the stated query set against all rows, in blocks; Spark broadcasts the packed queries only under its own size
    threshold), which gives a lower and an upper bound of each score; rows whose upper bound is below the
    kth lower bound of their block, and then of all blocks, are out. The second pass reads exact vectors of those left in
    the order of their bounds: the first 4k of each query, then those whose upper bound reaches the kth exact score.
    """
    v = vectors.where(F.col(id_col).isNotNull() & (F.size(vec) > 0))
    ok = F.forall(vec, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    scaled = lambda e: e.cast("double") * scale
    too_big = F.raise_error(F.lit("a scaled component does not fit")).cast("long")
    v = v.where(ok).select(
        F.monotonically_increasing_id().alias("k"), F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda e: F.when(F.abs(scaled(e)) < _LIMIT, F.floor(scaled(e))).otherwise(too_big)).alias("x"),
    )
    v = cut(v)
    got = v.mapInPandas(_edges, "w int, i int, low long, high long").groupBy("w", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    edges = {int(w): (e["low"].to_numpy(), np.maximum(1, (e["high"].to_numpy() - e["low"].to_numpy()) // CELLS + 1)) for w, e in got.sort_values("i").groupby("w")}
    shape = "block long, w int, ks binary, ids binary, x binary"
    cells = cut(v.mapInPandas(_pack(lambda x, w: ((x - edges[w][0]) // edges[w][1]).astype(np.uint8).tobytes(), rows), shape))
    asked = v.where(is_query(F.col("id")))
    packed = cut(asked.mapInPandas(_pack(lambda x, w: x.tobytes(), block), shape).select("w", F.col("ks").alias("qks"), F.col("ids").alias("qids"), F.col("x").alias("q")))
    # Each block of rows has one of ``spread`` numbers, and each block of queries all of them, so that vectors of one length are not one key of the join.
    numbered = cells.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(spread)))
    every = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    found = cut(numbered.join(every, ["w", "part"]).drop("part").mapInPandas(_bounds(edges, k), "qk long, k long, up double, down double"))
    by = Window.partitionBy("qk")
    sure = found.select("qk", "down", F.row_number().over(by.orderBy(F.col("down").desc())).alias("n")).where(F.col("n") <= k)
    sure = sure.groupBy("qk").agg(F.min("down").alias("sure"))  # the kth bound, or the least if there are fewer
    left = found.join(sure, "qk").where("up >= sure").select("qk", "k", "up", F.row_number().over(by.orderBy(F.col("up").desc(), "k")).alias("n"))
    left = cut(left)
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + p)
    queries = asked.select(F.col("k").alias("qk"), F.col("id").alias("query_id"), F.col("x").alias("y"))

    def read(some: DataFrame) -> DataFrame:
        return some.join(v, "k").join(queries, "qk").select("qk", "query_id", F.col("id").alias("vec_id"), product.alias("score"))

    best = Window.partitionBy("qk").orderBy(F.col("score").desc(), "vec_id")
    first = cut(read(left.where(F.col("n") <= 4 * k)))
    kth = first.select("qk", "score", F.row_number().over(best).alias("n")).where(F.col("n") == k).select("qk", F.col("score").alias("kth"))
    rest = read(left.where(F.col("n") > 4 * k).join(kth, "qk").where("up >= kth"))
    return first.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
