"""Retrieval: BM25 over a postings table, exact cosine, reciprocal-rank fusion, grouping by item."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import tokens, windows
from larder.operators import index

RRF = 60


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 120) -> DataFrame:
    """(doc_id, ordinal, text) windows of each whole text."""
    starts = F.posexplode(windows(F.length("text"), size, overlap))
    cut = docs.select("doc_id", "text", starts.alias("ordinal", "start"))
    return cut.select("doc_id", "ordinal", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("text"))


def bm25(chunks_: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, ordinal, score) for queries (query_id, text) over chunks (doc_id, ordinal, text, heading) that no index holds."""
    toks = index.postings(chunks_)
    return index.score(toks, index.lengths(toks), index.phrases(queries))


def rank_lexical(scores: DataFrame, items: DataFrame, most: int = 500) -> DataFrame:
    """Ranks 1..``most`` by score, newest (as text), platform, source and ordinal; ``items`` is (doc_id, published, platform, source_id)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("published").desc(), "platform", "source_id", "ordinal")
    return scores.join(items.select("doc_id", "published", "platform", "source_id"), "doc_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, key: str, vec: str, most: int) -> DataFrame:
    """Rows (key, vector) in packed blocks of at most ``most``; null and non-finite vectors are left out."""

    def pack(batches):
        for b in batches:
            b = b[b["v"].map(lambda a: a is not None and len(a) > 0)]
            for w, part in b.groupby(b["v"].map(len)):
                x = np.stack(part["v"].to_list()).astype(np.float64)
                ids, ok = part["k"].to_numpy(np.int64), np.isfinite(x).all(axis=1)
                for at in range(0, int(ok.sum()), most):
                    yield pd.DataFrame({"w": [w], "ks": [ids[ok][at : at + most].tobytes()], "xs": [x[ok][at : at + most].tobytes()]})

    return rows.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).mapInPandas(pack, "w int, ks binary, xs binary")


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each ``q``, equal scores to the smaller id."""
    at = np.lexsort((ids, -s, q))
    q, ids, s = q[at], ids[at], s[at]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    ok = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) < k
    return q[ok], ids[ok], s[ok]


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 500, rows: int = 1024, block: int = 256, spread: int = 16, groups: int = 8, held: int = 4_000_000) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best of unit vectors (doc_id, v) for each query (query_id, q), equal scores to the smaller id.

    Blocks of rows meet blocks of queries as matrices, on a grid of ``spread`` parts of the rows by ``groups`` of the queries. A task keeps ``k`` rows a query of one block over all blocks of
    a part and gives them out at its end (or above ``held`` rows), so rows are sent ``groups`` times and results ``spread`` times, however many there are. The merge is a window per query.
    """

    def scan(batches):
        cell, kept, floor = None, [], None

        def best():
            return _best(*map(np.concatenate, zip(*kept, strict=True)), k)

        def out():
            got = best() if kept else ([],)
            for at in range(0, len(got[0]), 20_000):
                q, ids, s = (x[at : at + 20_000] for x in got)
                yield pd.DataFrame({"query_id": q, "doc_id": ids, "score": s + 0.0})

        for b in batches:
            for r in b.itertuples(index=False):
                ids, qids = np.frombuffer(r.ks, np.int64), np.frombuffer(r.qs, np.int64)
                size = sum(len(x[0]) for x in kept)
                if (r.part, r.qs) == cell and size > min(2 * k * len(qids), held):
                    kept = [best()]
                    size = len(kept[0][0])
                    q, n = np.unique(kept[0][0], return_counts=True)
                    last = kept[0][2][np.cumsum(n) - 1]  # the least kept score of each query, which bounds it once it has k
                    at = np.minimum(np.searchsorted(q, qids), len(q) - 1)
                    floor = np.where((q[at] == qids) & (n[at] == k), last[at], -np.inf)
                if (r.part, r.qs) != cell or size > held:
                    yield from out()
                    cell, kept, floor = (r.part, r.qs), [], np.full(len(qids), -np.inf)
                s = np.round(np.frombuffer(r.qx).reshape(len(qids), -1) @ np.frombuffer(r.xs).reshape(len(ids), -1).T, 6)
                s[~np.isfinite(s)] = -np.inf
                # No row under the k-th score of its query, in this block or so far, can be one of the k best.
                least = floor if np.isfinite(floor).all() or k >= len(ids) else np.maximum(floor, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                kept.append((qids[i], ids[j], s[i, j]))
        yield from out()

    q = _packed(queries, "query_id", "q", block).select("w", F.col("ks").alias("qs"), F.col("xs").alias("qx"))
    kind = queries.schema["query_id"].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = q.withColumn("grp", slot("qs", groups)).withColumn("part", every(spread))
    v = _packed(vectors, "doc_id", "v", rows).withColumn("part", slot("ks", spread)).withColumn("grp", every(groups))
    # A merge join brings the pairs of a block of queries in a part one after the other; in another order more rows are given out, with the same result.
    got = q.join(v.hint("merge"), ["w", "part", "grp"]).mapInPandas(scan, "query_id long, doc_id long, score double")
    return top(got.withColumn("query_id", F.col("query_id").cast(kind)), k).drop("rank")


def pool_size(limit: int) -> int:
    """Candidates of each arm for ``limit`` results."""
    if isinstance(limit, bool) or not 1 <= limit <= 50:
        raise ValueError("limit must be a whole number from 1 to 50")
    return min(500, max(50, 10 * limit))


def fuse(lexical: DataFrame, semantic: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, ordinal, rank) and (query_id, doc_id, ordinal, rank, score), each cut to the pool of ``limit``.

    One row per citation: score 1 / (60 + rank) summed over the arms, best rank, the arms that found it, and the fused ``rank`` by score, best rank, lexical
    rank, cosine, newest, platform, source and ordinal, cut to the pool. ``items`` gives published, platform and source_id by doc_id.
    """
    pool = pool_size(limit)
    return _fused(lexical.where(F.col("rank") <= pool), semantic.where(F.col("rank") <= pool), items, ["query_id"]).where(F.col("rank") <= pool)


def _fused(lexical: DataFrame, semantic: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """All candidates of both arms with their fused rank."""
    keys = [*by, "doc_id", "ordinal"]
    l = lexical.select(*keys, F.col("rank").alias("lexical_rank"))
    s = semantic.select(*keys, F.col("rank").alias("semantic_rank"), F.col("score").alias("cosine"))
    both = l.join(s, keys, "full").join(items.select("doc_id", "published", "platform", "source_id"), "doc_id")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    found = lambda c, name: F.when(F.col(c).isNotNull(), F.lit(name))
    both = both.withColumn("score", F.round(part("lexical_rank") + part("semantic_rank"), 9)).withColumn("best_rank", F.least("lexical_rank", "semantic_rank"))
    both = both.withColumn("match_sources", F.concat_ws("|", found("lexical_rank", "fts"), found("semantic_rank", "vector")))
    w = Window.partitionBy(*by).orderBy(
        F.col("score").desc(), "best_rank", F.col("lexical_rank").asc_nulls_last(), F.col("cosine").desc_nulls_last(), F.col("published").desc_nulls_last(), "platform", "source_id", "ordinal",
    )
    return both.withColumn("rank", F.row_number().over(w))


def pools(limit: int) -> list[int]:
    """The pool of ``limit``, doubled up to 500."""
    out = [pool_size(limit)]
    while out[-1] < 500:
        out.append(min(500, 2 * out[-1]))
    return out


def widen(lexical: DataFrame, semantic: DataFrame, items: DataFrame, evidence: DataFrame, limit: int = 10) -> DataFrame:
    """The fused candidates of each query at the least pool of ``pools`` that holds ``limit`` items with evidence, or at the largest; ``pool`` tells which.

    All pools are tried side by side, so no query waits for another: a pool takes so many lexical ranks, 500 semantic ones, and so many of the fused list. Both
    arms hold at most 500 rows a query, and each row stands once for every pool. Items with evidence are counted in windows, so that the arms are computed once.
    Feed the result to ``group_hits`` with the same evidence and limit.
    """
    sizes = F.explode(F.array(*map(F.lit, pools(limit)))).alias("pool")
    l = lexical.where(F.col("rank") <= 500).select("*", sizes).where(F.col("rank") <= F.col("pool"))
    s = semantic.where(F.col("rank") <= 500).select("*", sizes)
    f = _fused(l, s, items, ["query_id", "pool"]).where(F.col("rank") <= F.col("pool"))
    f = f.join(evidence.select("doc_id", F.lit(True).alias("_told")).distinct(), "doc_id", "left")
    n = F.size(F.collect_set(F.when(F.col("_told"), F.col("doc_id"))).over(Window.partitionBy("query_id", "pool")))  # 500 at most
    enough = F.min(F.when((F.col("_n") >= limit) | (F.col("pool") == 500), F.col("pool"))).over(Window.partitionBy("query_id"))
    return f.withColumn("_n", n).withColumn("_pool", enough).where(F.col("pool") == F.coalesce("_pool", F.lit(500))).drop("_told", "_n", "_pool")


def phrase(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose index tokens hold the tokens of ``text`` next to each other."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return docs.where(F.contains(spaced(F.col("text")), spaced(F.lit(text))))


def allowed(items: DataFrame, tasks: DataFrame | None = None, filed: DataFrame | None = None, platforms=None, content_types=None, folders=None) -> DataFrame:
    """doc_id of available items that pass the metadata filters; a filter left out lets all pass."""
    ok = items.where("access_status = 'available'")
    ok = ok.where(F.col("platform").isin(*platforms)) if platforms else ok
    ok = ok.where(F.col("content_type").isin(*content_types)) if content_types else ok
    if tasks is not None:  # indexed: a completed task for the item
        ok = ok.join(tasks.where("status = 'completed'").select("doc_id"), "doc_id", "left_semi")
    if folders:
        ok = ok.join(filed.where(F.col("name").isin(*folders)).select("doc_id"), "doc_id", "left_semi")
    return ok.select("doc_id")


def collapse_segments(scores: DataFrame, owner) -> DataFrame:
    """Best segment of each owner; equal scores go to the smaller segment."""
    best = F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("segment")
    return scores.groupBy("query_id", owner.alias("doc_id")).agg(F.max("score").alias("score"), best)


def group_hits(fused: DataFrame, evidence: DataFrame, limit: int = 10, supporting: int = 3) -> DataFrame:
    """One row per query and item (doc_id): its best chunk, up to ``supporting`` more, score times the item's evidence factor.

    ``fused`` comes from ``fuse``; ``evidence`` is (doc_id, factor), and items without evidence are left out. Items rank by adjusted score, best rank,
    platform, source and ordinal. The lists are bounded by the pools that were fused. ``pool`` is kept where ``fused`` comes from ``widen``.
    """
    by = ["query_id", *(["pool"] if "pool" in fused.columns else [])]  # one pool a query
    c = fused.withColumnRenamed("rank", "_at").join(evidence.select("doc_id", "factor"), "doc_id")
    w = Window.partitionBy("query_id", "doc_id").orderBy("_at")
    c = c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= supporting + 1)
    rest = F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", "ordinal"))))
    first = lambda x: F.max(F.when(F.col("_n") == 1, F.col(x)))
    g = c.groupBy(*by, "doc_id", "platform", "source_id").agg(first("ordinal").alias("ordinal"), first("best_rank").alias("_best"), (first("score") * first("factor")).alias("adjusted"), rest.alias("_rest"))
    g = g.withColumn("supporting", F.array_join(F.transform("_rest", lambda s: s["ordinal"].cast("string")), "|"))
    o = Window.partitionBy("query_id").orderBy(F.col("adjusted").desc(), "_best", "platform", "source_id", "ordinal")
    return g.withColumn("rank", F.row_number().over(o)).where(F.col("rank") <= limit).drop("_best", "_rest")
