"""Benchmark decontamination with spaced seeds, verified by substitution-tolerant alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, hashes_of, spare, table, word_bytes

#: Fixed masks over ten tokens: 1 is compared, 0 is ignored. Each compares seven.
MASKS = ("1110110011", "1101011101", "1011101110", "1111111000", "0111011011")
WINDOW = len(MASKS[0])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _each(hashes, short=()):
    """(size, hashes of all windows) of every mask, and of whole runs of each size in ``short``."""
    h = np.asarray(hashes).view(np.uint64)
    for m, mask in [*enumerate(MASKS), *((len(MASKS) + k, "1" * k) for k in short)]:
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        acc = np.full(n, np.uint64(m + 1), np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                acc = acc * _MIX + h[j : n + j]
                acc ^= acc >> np.uint64(31)
        yield len(mask), acc.view(np.int64)


def seeds(hashes) -> list[tuple[int, int]]:
    """(position, hash) of every window of an item under every mask; of a shorter item, its one whole run."""
    short = [len(hashes)] if 0 < len(hashes) < WINDOW else []
    return [(i, x) for _, acc in _each(hashes, short) for i, x in enumerate(acc.tolist())]


def _runs(texts: pd.Series, most: int = 1 << 19):
    """(word hashes of some texts in a row, where each begins, end), about ``most`` words at a time; no text is split."""
    part, at, starts = [], 0, []
    for t in texts:
        h = hashes_of(word_bytes(t))
        starts.append(at)
        part.append(h)
        at += len(h)
        if at >= most:
            yield np.concatenate(part), np.array([*starts, at])
            part, at, starts = [], 0, []
    if part:
        yield np.concatenate(part), np.array([*starts, at])


def overlap(doc: np.ndarray, item: np.ndarray, diag: int, miss: int = 4) -> tuple[int, int]:
    """(matching tokens of the best run on one diagonal, where each mismatch outweighs ``miss`` matches; those of the whole diagonal)."""
    lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
    if hi <= lo:
        return 0, 0
    same = item[lo:hi] == doc[lo + diag : hi + diag]
    total = np.r_[0, np.cumsum(np.where(same, 1, -miss))]
    low = np.minimum.accumulate(total)  # the best run to a place begins where the sum was least
    end = int((total - low).argmax())
    begin = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return int(same[begin:end].sum()), int(same.sum())


def _name(text) -> Column:
    """128 bits of a whole text, with null apart from the empty text."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


_SEED = "array<struct<pos:int,h:long>>"


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", least: int = 12, bits: int = 24) -> DataFrame:
    """``docs`` with all its columns plus ``bench_items_`` (distinct items met) and ``bench_overlap_`` (tokens).

    Both texts become lower-cased words. Every window of ten words is hashed under five masks, of which
    each position is ignored by one at least. Of an item under ten words nine tenths are all its words, so it
    is hashed as a whole, and so are the documents' windows of its size. A bitmap of 2^``bits`` bits, two to a
    benchmark hash (its size is fixed), keeps most training windows from being shuffled; those left join on the hash itself. Each hit names
    a diagonal, on which at least ``least`` tokens must match, or nine tenths of a shorter item,
    with at most one substitution per four matches. An item of one word is met by each document that
    has the word. Null and empty texts match nothing. Equal texts, and so repeated rows, share one check; null and repeated ids do no harm. A threshold met exactly is met. An empty
    table of documents gives no rows, an empty benchmark meets nothing. The caller's columns are kept, but for columns of the two new names, which are replaced.
    """
    bits_mask = (1 << bits) - 1

    def windows(texts: pd.Series) -> pd.DataFrame:
        found = [hashes_of(word_bytes(t)) for t in texts]
        return pd.DataFrame({"w": [h.view(np.int64) for h in found], "s": [seeds(h) for h in found]})

    seeded = f"w array<long>, s {_SEED}"
    b = bench.select(_name(F.col(text)).alias("item"), F.col(text).alias("_text")).dropDuplicates(["item"])
    b = b.withColumn("s", F.pandas_udf(windows, seeded)("_text")).select("item", F.col("s.w").alias("bw"), "s.s")
    b = cut(b.where(F.size("bw") > 0))
    short = sorted(r[0] for r in b.select(F.size("bw")).where(F.size("bw") < WINDOW).distinct().collect())
    bs = b.select("item", F.explode("s").alias("s")).select("item", F.col("s.pos").alias("bpos"), F.col("s.h").alias("h"))
    probes = F.array(*[F.shiftright("h", n).bitwiseAND(F.lit(bits_mask)).cast("int") for n in (0, 32)])
    spots = bs.select(F.explode(probes).alias("i")).distinct().toPandas()["i"].to_numpy(dtype=np.int64)
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    np.bitwise_or.at(bitmap, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def likely(texts: pd.Series) -> pd.DataFrame:
        held = np.frombuffer(shared.value, np.uint8)
        ws, ss = [], []
        for h, starts in _runs(texts):
            found = [(np.empty(0, np.int64),) * 3]
            for size, x in _each(h, short):
                pos = np.arange(len(x))
                for shift in (0, 32):  # the second probe meets the few that the first left
                    i = (x >> shift) & bits_mask
                    keep = (held[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
                    pos, x = pos[keep], x[keep]
                doc = np.searchsorted(starts, pos, "right") - 1
                inside = pos + size <= starts[doc + 1]
                pos, x, doc = pos[inside], x[inside], doc[inside]
                if size < WINDOW:  # a whole item: its first place in a document tells as much as all
                    once = np.unique(np.stack([doc, x]), axis=1, return_index=True)[1]
                    pos, x, doc = pos[once], x[once], doc[once]
                found.append((pos, x, doc))
            pos, x, doc = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(len(starts)))
            for d in range(len(starts) - 1):
                mine = order[cuts[d] : cuts[d + 1]]
                ss.append([(int(p - starts[d]), int(y)) for p, y in zip(pos[mine], x[mine])])
                ws.append(h[starts[d] : starts[d + 1]].view(np.int64) if len(mine) else None)
        return pd.DataFrame({"w": ws, "s": ss})

    key = spare(docs, "_doc")
    d = docs.withColumn(key, _name(F.col(text)))
    one = d.select(F.col(key).alias("doc"), F.pandas_udf(likely, seeded)(F.col(text)).alias("f")).select("doc", F.col("f.w").alias("dw"), F.col("f.s").alias("s")).where(F.size("s") > 0)
    one = cut(one.groupBy("doc").agg(F.first("dw").alias("dw"), F.first("s").alias("s")))
    hits = one.select("doc", F.explode("s").alias("s")).select("doc", F.col("s.pos").alias("dpos"), F.col("s.h").alias("h")).join(bs, "h")
    hits = hits.groupBy("doc", "item").agg(F.collect_set(F.col("dpos") - F.col("bpos")).alias("diags"))  # no more than a document has places

    def check(doc: pd.Series, item: pd.Series, diags: pd.Series) -> pd.Series:
        out = []
        for x, y, zs in zip(doc, item, diags):
            best = 0
            for z in zs:
                run, whole = overlap(np.asarray(x), np.asarray(y), int(z))
                best = max(best, run if len(y) * 0.9 > least else max(run, whole))
            out.append(best if best >= min(least, 0.9 * len(y)) else 0)
        return pd.Series(out, dtype="int64")

    pairs = hits.join(one.select("doc", "dw"), "doc").join(b.select("item", "bw"), "item")
    good = pairs.select("doc", F.pandas_udf(check, "long")("dw", "bw", "diags").alias("n")).where("n > 0")
    made = ("bench_items_", "bench_overlap_")
    good = good.groupBy("doc").agg(F.count("*").alias(made[0]), F.max("n").alias(made[1])).withColumnRenamed("doc", key)
    out = d.drop(*made).join(good, key, "left").drop(key)
    return out.fillna(0, list(made))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col("bench_items_") > 0).alias("contaminated"), F.col("bench_items_").alias("n_items"), F.col("bench_overlap_").alias("overlap"))
