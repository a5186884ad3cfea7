"""MinHash near-dedup with tensored banding, verified on full shingle sets."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, hashes_of, table, word_bytes

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(hashes, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles; fewer words make one shingle of them all."""
    h = np.asarray(hashes, dtype=np.uint64)
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(k, n)
    acc = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        acc = _scramble(acc * _MIX + h[i : n - size + 1 + i])
    return np.unique(acc)


def _signer(k: int, tuples: int, width: int, seed: int):
    """Arrow UDF: text -> digest of its word sequence, set size, two collections of ``tuples`` keys of ``width`` minhashes, parities.

    The parities are 512 bits: each tells whether an odd number of the set's hashes fall on it. Two sets differ in
    at least as many hashes as their parities in bits.
    """
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, 2 * tuples * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, 2 * tuples * width, dtype=np.uint64)

    def sign(texts: pd.Series) -> pd.DataFrame:
        digests, sizes, keys, parities = [], [], [], []
        for t in texts:
            w = word_bytes(t)
            s = shingle_set(hashes_of(w), k)
            digests.append(xxhash.xxh3_128_digest(b" ".join(w)))
            sizes.append(len(s))
            if not len(s):
                keys.append([])
                parities.append([])
                continue
            low = np.full(len(mul), np.uint64(2**64 - 1), np.uint64)
            for at in range(0, len(s), 1024):  # bounded memory on very long texts
                part = _scramble(s[None, at : at + 1024] * mul[:, None] + add[:, None])
                low = np.minimum(low, part.min(axis=1))
            acc = np.arange(2 * tuples, dtype=np.uint64)
            for j in range(width):
                acc = _scramble(acc * _MIX + low[j::width])
            keys.append(acc.view(np.int64))
            odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1
            parities.append(np.packbits(odd).view(np.int64))
        return pd.DataFrame({"seq": digests, "n": sizes, "keys": keys, "odd": parities})

    return F.pandas_udf(sign, "seq binary, n long, keys array<long>, odd array<long>")


def _sets(k: int):
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(hashes_of(word_bytes(t)), k).view(np.int64) for t in texts])

    return F.pandas_udf(make, "array<long>")


def _components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node reachable over ``edges`` (a, b), by min labels with pointer jumps."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    lab = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    for _ in range(rounds):
        seen = both.join(lab.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
        near = seen.groupBy("a").agg(F.min("l").alias("m"))
        step = lab.join(near, lab.node == near.a).select("node", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        jump = lab.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = cut(step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), "was"))
        moved = new.where("label <> was").limit(1).count()
        lab = new.select("node", "label")
        if not moved:
            return lab
    raise RuntimeError("components did not settle")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, tuples: int = 12, width: int = 2, seed: int = 7, rounds: int = 4, meets: int = 8, key: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row, and ``key`` if given: a column with another value in each row.

    Rows with equal word sequences form a class first, so copies never meet pair by pair. A class goes by the
    least hash of its texts, not by an id, so null and repeated ids do no harm. One row of each component is
    kept: that of least id, null ids last, then of least hash of the text; its id is the ``component_id``.
    Each class has two collections of ``tuples`` small keys; a table is a pair of one from each,
    which gives tuples^2 tables from 2 * tuples * width minhashes (at similarity 0.8 a pair
    shares no table with probability 1e-5). Only small keys that two classes hold can form a table
    that two classes share, so the others go before the pairs are formed.

    In each of ``rounds`` rounds every bucket that still holds several components has a centre, the least of its classes
    under an order of that round, and every class meets one centre of another component, that of its largest
    bucket. So a round confirms at most one pair a class, however large a group is, and joins most of a group.
    Last, each class outside its bucket's largest component meets the classes of other components it shares a table with, once
    for each pair; pairs whose sizes or parities show that they differ too much are left out
    inside the join, which cannot lose a link. All other pairs are confirmed on full sets. So any two classes
    that share a table are compared, shown to be apart, or already joined.
    Components settle in a few passes; after 60 the search raises an error.

    Texts without words (null, empty, blank) are linked with nothing, and each is kept. An empty table gives no rows. Only
    the named columns are read, so other columns cannot clash. ``k`` is the length of a shingle in words:
    five by default, as all stages on word shingles take, two where a contract says so.
    """
    sign = _signer(k, tuples, width, seed)
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_row"), F.col(text).alias("_text"), (F.col(key) if key else F.monotonically_increasing_id()).alias("_key"))
    base = cut(src.select("_id", "_row", "_key", sign("_text").alias("s")).select("_id", "_row", "_key", F.col("s.seq").alias("_seq"), "s.n", "s.keys", "s.odd"))
    full = base.where("n > 0")
    best = F.min(F.struct(F.col("_id").isNull().alias("void"), "_id", "_row", "_key")).alias("best")
    classes = cut(full.groupBy("_seq").agg(F.min("_row").alias("rep"), best, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd")))
    small = classes.select("rep", "n", F.posexplode("keys").alias("i", "key"))
    shared = small.groupBy("key").count().where("count > 1").select("key")
    live = small.join(shared, "key").groupBy("rep", "n").agg(F.collect_list(F.struct("i", "key")).alias("live"))  # 2 * tuples at most
    side = lambda left: F.filter("live", lambda x: (x["i"] < tuples) == F.lit(left))
    t = live.select("rep", "n", F.explode(side(True)).alias("l"), "live").select("rep", "n", "l", F.explode(side(False)).alias("r"))
    t = cut(t.select("rep", "n", F.col("rep").alias("label"), F.xxhash64("l.key", "r.key").alias("key")))
    many = t.groupBy("key").count().where("count > 1")
    t = cut(t.join(many.select("key"), "key"))
    # The sets of all classes that may meet another, once; the text is shuffled, not its hashes.
    sets = src.select("_row", "_text").join(t.select(F.col("rep").alias("_row")).distinct(), "_row", "left_semi").dropDuplicates(["_row"])
    sets = cut(sets.select("_row", _sets(k)("_text").alias("set")))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Linked pairs as edges between the labels of their components."""
        p = pairs.join(sets.select(F.col("_row").alias("rep"), F.col("set").alias("x")), "rep")
        p = p.join(sets.select(F.col("_row").alias("c"), F.col("set").alias("y")), "c")
        both = F.size(F.array_intersect("x", "y"))
        return p.where(both * den >= (F.size("x") + F.size("y") - both) * num).select(F.col("label").alias("a"), F.col("lc").alias("b"))

    def alike(n, m):
        return F.least(n, m) * den >= F.greatest(n, m) * num

    def follow(labels: DataFrame, to: DataFrame) -> DataFrame:
        """``labels`` after the components were joined as ``to`` (node, label) says."""
        to = to.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        return labels.join(to, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")

    lab = t.select("rep", "label").distinct()
    for i in range(rounds):
        own = t.groupBy("key", "label").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("rep", F.lit(seed + i)).alias("o"), "rep", "n")).alias("c"))
        main = own.groupBy("key").agg(F.max(F.struct("m", "label", "c")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1")
        main = main.select("key", F.col("x.label").alias("lc"), F.col("x.c.rep").alias("c"), F.col("x.c.n").alias("nc"), F.col("x.m").alias("m"))
        met = t.join(main, "key").where((F.col("label") != F.col("lc")) & alike(F.col("n"), F.col("nc")))
        pick = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("m")).alias("m"), "c", "lc")), lambda p, q: F.when(p["m"] < q["m"], -1).when(p["m"] > q["m"], 1).when(p["c"] < q["c"], -1).otherwise(F.when(p["c"] > q["c"], 1).otherwise(0))), 1, meets if i else 1)
        links = cut(confirm(met.groupBy("rep", "label").agg(pick.alias("p")).select("rep", "label", F.explode("p").alias("p")).select("rep", "label", "p.c", "p.lc").distinct()))
        to = _components(links)
        lab, t = cut(follow(lab, to)), follow(t, to)
        now = t.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2")
        t = cut(t.join(now.select("key"), "key"))
    # Which classes are left apart in some bucket: they meet by their keys of the first collection.
    ks, ps = [f"k{j}" for j in range(2 * tuples)], [f"p{j}" for j in range(8)]
    flat = [F.coalesce(F.get(c, F.lit(j)), F.lit(0)).alias(f"{c[0].replace('o', 'p')}{j}") for c, m in (("keys", 2 * tuples), ("odd", 8)) for j in range(m)]
    rest = t.select("rep").distinct().join(lab, "rep").join(classes.select("rep", "n", "keys", *flat), "rep")
    rest = cut(rest.select("rep", "label", "n", *ks, *ps, F.posexplode(F.slice("keys", 1, tuples)).alias("i", "key")))
    main = rest.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    out = rest.join(main, "key").where("label <> main").select("key", "main", *[F.col(c).alias(f"{c}_") for c in ("i", "rep", "label", "n", *ks, *ps)])
    same = [F.col(c) == F.col(f"{c}_") for c in ks]
    once = reduce(and_, [~((F.col("i_") > j) & same[j]) for j in range(tuples)])  # at the first key they share
    apart = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in ps])
    near = alike(F.col("n"), F.col("n_")) & (apart * (den + num) <= (F.col("n") + F.col("n_")) * (den - num))
    turn = (F.col("label") == F.col("main")) | (F.col("rep_") < F.col("rep"))
    late = out.join(rest, "key").where((F.col("label") != F.col("label_")) & turn & near & reduce(or_, same[tuples:]) & once)
    late = late.select("rep", "label", F.col("rep_").alias("c"), F.col("label_").alias("lc"))
    lab = follow(lab, _components(cut(confirm(late))))
    seq = classes.select("_seq", "rep", "best").join(lab, "rep", "left").select("_seq", F.coalesce("label", "rep").alias("label"), "best")
    seq = cut(seq)
    one = seq.groupBy("label").agg(F.min("best").alias("first"))
    seq = seq.join(one, "label").select("_seq", "first")
    out = base.select("_id", "_key", "_seq", "n").join(seq, "_seq", "left")
    own = F.when(F.col("n") > 0, F.col("first._id")).otherwise(F.col("_id"))
    kept = (F.col("n") == 0) | (F.col("_key") == F.col("first._key"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"), *([F.col("_key").alias(key)] if key else []))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"), k=2)
