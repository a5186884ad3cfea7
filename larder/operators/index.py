"""Stored inverted index: one row per term and field of a chunk with the places, written once in generations, read by term.

A build or a re-index writes a generation: its postings (by bucket of the term; each file holds runs that are sorted by term, so a search reads the buckets of
its terms and within them the pages that hold them), the length of each chunk, and the items it touched. A row of the commit log makes it visible, so a
job that was lost half way leaves nothing that is read, and running it again replaces its files. An item's rows are those of the last generation that touched it.

Tokens are never shuffled or sorted as rows: a task groups those of a few thousand chunks at a time and writes one compressed block a bucket, and each bucket is unpacked from its blocks into its own folder.
"""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import CJK_RANGES, cjk_bigrams, query_tokens, spaced, tokens, unmarked

K1, B = 1.2, 0.75
KEYS = ["doc_id", "ordinal"]
ROW = "term string, doc_id long, ordinal int, len int, field int, places array<int>, times int"
POSTING = f"{ROW}, gen int, bucket int"
PACKED = "bucket int, block binary"
# Chunks grouped at a time, the bucket number of their own table, and buckets unpacked side by side.
GROUPED, CHUNKS, AT_ONCE = 4096, -1, 4
# Pages far smaller than a run (of 4096 chunks), so that a search passes over those without its terms; ids do not repeat within a term, so a dictionary of them is work for nothing.
PAGES = {"parquet.page.row.count.limit": "2000", "parquet.enable.dictionary#doc_id": "false"}
LENGTH = "doc_id long, ordinal int, len int, gen int"
TOUCHED = "doc_id long, gen int"
COMMIT = "gen int, base int, buckets int, chunks long"


def _fields(chunks: DataFrame) -> DataFrame:
    """Tokens of the fields of chunks (doc_id, ordinal, text, heading, and ``pairs`` where a table has it), with blanks between them: ``t`` of the text, ``h`` of its heading, ``p`` of the text with CJK runs as pairs.

    Without CJK the first and third are the same and are stored once, for two. (Few texts have a character of the one wide range, and only those are looked at for the exact ones.)
    """
    c = chunks if "pairs" in chunks.columns else chunks.withColumn("pairs", F.lit(None).cast("string"))
    cjk = F.col("text").rlike(f"[{CJK_RANGES[0:6]}-{CJK_RANGES[-6:]}]") & F.col("text").rlike(f"[{CJK_RANGES}]")
    c = c.select(*KEYS, F.coalesce(cjk, F.lit(False)).alias("cjk"), spaced(F.col("text")).alias("t"), spaced(F.col("heading")).alias("h"), "text", "pairs")
    c = c.withColumn("p", F.when(F.col("cjk"), spaced(F.coalesce("pairs", cjk_bigrams(F.col("text"))))))
    return c.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("int").alias("ordinal"), "cjk", "t", "h", "p")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words between the blanks of texts, one after the other, with the row and the place of each, and how many a row has."""
    lists = pc.ascii_split_whitespace(texts)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat, rows = lists.flatten(), np.repeat(np.arange(len(n)), n)
    full = pc.greater(pc.binary_length(flat), 0)  # blanks at the ends give empty words
    flat, rows = flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    n = np.bincount(rows, minlength=len(n))
    return flat, rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n), n


def _block(**lists) -> bytes:
    """Arrays in one row, compressed."""
    row = pa.record_batch({k: pa.LargeListArray.from_arrays([0, len(x)], x) for k, x in lists.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(row)
    return out.getvalue().to_pybytes()


def _grouped(b: pa.RecordBatch, buckets: int):
    """(bucket, block) of a few thousand chunks: the chunks' own table, and of each bucket its terms in order with the chunks, fields and places of each."""
    cut = {x: _words(b.column(x)) for x in "thp"}
    cjk = b.column("cjk").to_numpy(zero_copy_only=False)
    size = cut["t"][3] + cut["h"][3] + np.where(cjk, cut["p"][3], cut["t"][3])  # of all fields
    held = {"doc_id": b.column("doc_id"), "ordinal": b.column("ordinal"), "len": pa.array(size.astype(np.int32)), "cjk": b.column("cjk")}
    yield CHUNKS, _block(**held)
    words = pa.concat_arrays([x[0] for x in cut.values()]).dictionary_encode()
    if not len(words):
        return
    plain = unmarked(pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")[0].as_py()).encode().split(b" ")
    hashed = np.fromiter(map(zlib.crc32, plain), np.int64, len(plain))
    plain = pa.array(plain, pa.binary()).dictionary_encode()  # different words may have the same plain one
    code, words = plain.indices.to_numpy()[words.indices.to_numpy()], plain.dictionary
    of = np.empty(len(words), np.int64)
    of[plain.indices.to_numpy()] = hashed % buckets
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    order = order[np.argsort(of[order], kind="stable")]  # by bucket, then by word
    rank = np.empty(len(of), np.int64)
    rank[order] = np.arange(len(of))
    rows, places = (np.concatenate([x[i] for x in cut.values()]) for i in (1, 2))
    fields = np.repeat(np.arange(3), [len(x[1]) for x in cut.values()])
    # A key is a plain number: the word, the chunk, the field (two bits) and the place.
    low, wide = int(places.max()).bit_length(), b.num_rows.bit_length() + 2
    key = np.sort(rank[code] << wide + low | rows << 2 + low | fields << low | places)
    places, key = key & (1 << low) - 1, key >> low
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # of each term, chunk and field
    key, end = key[begin], np.r_[begin, len(key)]
    count, fields, rows, key = np.diff(end), key & 3, (key & (1 << wide) - 1) >> 2, key >> wide
    edges = np.searchsorted(key, np.searchsorted(of[order], np.arange(buckets + 1)))
    small = lambda x: pa.array(x.astype(np.int16 if x.max() < 2**15 else np.int32))
    for bucket, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        if lo < hi:
            first = np.flatnonzero(np.r_[True, key[lo + 1 : hi] != key[lo : hi - 1]])  # of each term
            mine, times = order[key[lo:hi][first]], np.diff(np.r_[first, hi - lo])
            yield bucket, _block(words=words.take(pa.array(mine)).cast(pa.string()), times=pa.array(times), rows=small(rows[lo:hi]), fields=pa.array(fields[lo:hi].astype(np.int8)), counts=small(count[lo:hi]), places=small(places[end[lo] : end[hi]]), **held)


def _packed(chunks: DataFrame, buckets: int) -> DataFrame:
    """The postings of chunks as (bucket, block)."""

    def group(batches):
        for b in batches:
            for at in range(0, b.num_rows, GROUPED):
                got = list(_grouped(b.slice(at, GROUPED), buckets))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "block"])

    return _fields(chunks).mapInArrow(group, PACKED)


def _unpacked(packed: DataFrame) -> DataFrame:
    """Posting rows of blocks; a block of the chunks' own table gives a row without term for each."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def rows(block: bytes) -> pa.RecordBatch:
        x = pa.ipc.open_stream(block).read_next_batch()
        x = {k: x.column(k).flatten() for k in x.schema.names}
        n = len(x["doc_id"])
        own = "words" not in x
        at = np.arange(n) if own else x["rows"].to_numpy().astype(np.int64)
        field = np.zeros(n, np.int8) if own else x["fields"].to_numpy()
        count = np.zeros(n, np.int64) if own else x["counts"].to_numpy().astype(np.int64)
        term = pa.nulls(n, pa.string()) if own else x["words"].take(pa.array(np.repeat(np.arange(len(x["words"])), x["times"].to_numpy()))).cast(pa.string())
        places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array([], pa.int32()) if own else x["places"].cast(pa.int32()))
        cjk = x["cjk"].to_numpy(zero_copy_only=False)[at]
        held = [x[k].take(pa.array(at)) for k in (*KEYS, "len")]
        return pa.RecordBatch.from_arrays([term, *held, pa.array(field, pa.int32()), places, pa.array(np.where(cjk | (field > 0), 1, 2), pa.int32())], names)

    def spread(batches):
        for b in batches:
            for block in b.column("block"):
                got = rows(block.as_py())
                for at in range(0, got.num_rows, 20_000):
                    yield got.slice(at, 20_000)

    return packed.select("block").mapInArrow(spread, ROW)


def postings(chunks: DataFrame) -> DataFrame:
    """Rows of chunks (doc_id, ordinal, text, heading): a term in a field of a chunk, its places there, and how many fields the field stands for; and for each chunk one without a term, so that all lengths are told."""
    return _unpacked(_packed(chunks, 1))


def lengths(postings_: DataFrame) -> DataFrame:
    """(doc_id, ordinal, len) of each chunk, also of chunks without tokens."""
    return postings_.where("term is null").select(*KEYS, "len")


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, terms): each token of a query is a phrase of the terms it expands to; a repeated token counts again. A query without tokens has none."""
    words = queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("_w"))
    return words.select("query_id", tokens(cjk_bigrams(F.col("_w"))).alias("terms")).where(F.size("terms") > 0)


def score(found: DataFrame, held: DataFrame, asked: DataFrame, long: bool = True) -> DataFrame:
    """(query_id, doc_id, ordinal, score): BM25 of the phrases ``asked`` over the postings ``found`` (at least those of their terms) and the lengths of all chunks.

    A phrase stands where its terms follow each other within one field: its i-th term at place p gives p - i, and a begin that all terms give
    counts. Length and frequency sum over the fields, and totals count every chunk, as filters come after. Postings are dealt by chunk once, for phrases and queries alike. ``long``: whether a phrase has more than one term.
    """
    asked = asked.withColumn("phrase", F.array_join("terms", " "))  # a term has no blank
    parts = asked.select("phrase", "terms").distinct().select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term"))
    one = F.when(F.col("n") == 1, F.size("places") * F.col("times")).alias("one")
    votes = found.join(F.broadcast(parts), "term")  # of requests, not of rows
    votes = votes.select("phrase", "n", *KEYS, "len", one, *([F.when(F.col("n") > 1, F.struct("field", "times", F.transform("places", lambda p: p - F.col("i")).alias("begins"))).alias("spot")] if long else []))
    votes = votes.repartition(*KEYS)
    if long:
        tf_ = votes.groupBy("phrase", "n", *KEYS, "len").agg(F.sum("one").alias("one"), F.collect_list("spot").alias("spots"))  # a phrase's terms in one chunk, at most three times each

        def begins(field):
            got = F.filter("spots", lambda s: s["field"] == field)
            both = F.aggregate(got, F.get(got, F.lit(0))["begins"], lambda a, s: F.array_intersect(a, s["begins"]))
            return F.when(F.size(got) == F.col("n"), F.size(both) * F.get(got, F.lit(0))["times"]).otherwise(0)

        tf_ = tf_.select("phrase", *KEYS, "len", F.when(F.col("n") == 1, F.col("one")).otherwise(begins(0) + begins(1) + begins(2)).alias("tf")).where("tf > 0")
    else:
        tf_ = votes.groupBy("phrase", *KEYS, "len").agg(F.sum("one").alias("tf")).where("tf > 0")  # all are; with this the counts below need the same columns, so that postings are read and dealt once, unless a later join pushes a filter below one of the two
    df_ = tf_.groupBy("phrase").agg(F.count("*").alias("df"))
    stats = held.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    n, tf = F.col("n"), F.col("tf")
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    # One row of totals, and one of each phrase, meet every posting.
    got = tf_.join(F.broadcast(df_), "phrase").join(F.broadcast(stats)).select("phrase", *KEYS, part.alias("p"))
    return got.join(F.broadcast(asked.select("query_id", "phrase")), "phrase").groupBy("query_id", *KEYS).agg(F.round(F.sum("p"), 6).alias("score"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def _write(df: DataFrame, root: str, name: str, gen: int, by: tuple[str, ...] = ()) -> None:
    """Write a generation, in place of all that a lost job may have left of it."""
    df.drop("gen").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{root}/{name}/gen={gen}")


def commits(spark: SparkSession, root: str) -> list:
    """Rows of the commit log by generation: one for each build or re-index."""
    return sorted(_read(spark, root, "commits", COMMIT).collect())


def available(spark: SparkSession, root: str) -> bool:
    """Whether there is an index that can be searched: a commit log, and the files that its generations name."""
    try:
        log = commits(spark, root)
        held = {r["gen"] for r in _read(spark, root, "lengths", LENGTH).select("gen").distinct().collect()}
        _read(spark, root, "postings", POSTING).take(1)
    except Exception as e:  # the reader's error for a folder that is not there
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return bool(log) and all(r["gen"] in held or not r["chunks"] for r in log if r["gen"] >= log[-1]["base"])


def _publish(chunks: DataFrame, touched: DataFrame | None, root: str, gen: int, base: int, buckets: int) -> None:
    spark = chunks.sparkSession
    _write(_packed(chunks, buckets), root, "packed", gen, ("bucket",))  # few rows: a block a bucket for each few thousand chunks
    blocks = _read(spark, root, f"packed/gen={gen}", PACKED)
    unpack = lambda b: _unpacked(blocks.where(F.col("bucket") == b))

    def spread(b):
        # A folder of its own for each bucket, so that no task sorts its rows by bucket.
        unpack(b).write.mode("overwrite").options(**PAGES).parquet(f"{root}/postings/gen={gen}/bucket={b}")

    with ThreadPoolExecutor(AT_ONCE) as several:
        list(several.map(spread, range(buckets)))
    _write(lengths(unpack(CHUNKS)), root, "lengths", gen)
    held = _read(spark, root, "lengths", LENGTH).where(F.col("gen") == gen)
    _write((held if touched is None else touched).select("doc_id").distinct(), root, "touched", gen)  # (a build's items have all lengths, and no text is read for them)
    _write(spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PACKED.split(", ")))), root, "packed", gen)  # the blocks are no longer needed
    row = dict(gen=gen, base=base, buckets=buckets, chunks=held.count())
    spark.range(1).select(*(F.lit(row[c]).cast(t).alias(c) for c, t in (x.split() for x in COMMIT.split(", ")))).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def build(chunks: DataFrame, root: str, buckets: int = 16) -> None:
    """Index all chunks anew; with an index there already this is its rebuild, after which older generations are not read."""
    spark = chunks.sparkSession
    gen = commits(spark, root)[-1]["gen"] + 1 if available(spark, root) else 0
    _publish(chunks, None, root, gen, gen, buckets)


def reindex(chunks: DataFrame, touched: DataFrame, root: str) -> None:
    """Replace the chunks of the ``touched`` items (doc_id) by those among ``chunks``; a touched item without chunks leaves the index.

    Nothing but the chunks of touched items is read or written.
    """
    log = commits(chunks.sparkSession, root)[-1]
    fresh = chunks.join(touched.select("doc_id").distinct(), "doc_id", "left_semi")
    _publish(fresh, touched, root, log["gen"] + 1, log["base"], log["buckets"])


def repair(chunks: DataFrame, touched: DataFrame, root: str) -> str:
    """Re-index the touched items, after a rebuild if there is no index that can be searched; which of the two was done."""
    if not available(chunks.sparkSession, root):
        build(chunks, root)
        return "rebuilt"
    reindex(chunks, touched, root)
    return "reindexed"


def _live(rows: DataFrame, root: str, log: list) -> DataFrame:
    """Rows of the generations since the last build, each item's from the last that touched it."""
    base, last = log[-1]["base"], log[-1]["gen"]
    rows = rows.where(F.col("gen").between(base, last))
    if base == last:
        return rows
    later = _read(rows.sparkSession, root, "touched", TOUCHED).where(F.col("gen").between(base + 1, last))
    later = later.groupBy("doc_id").agg(F.max("gen").alias("_last"))
    return rows.join(later, "doc_id", "left").where(F.col("gen") >= F.coalesce("_last", F.lit(base))).drop("_last")


def search(spark: SparkSession, root: str, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, ordinal, score) for queries (query_id, text), any number at once, from the index alone.

    The terms of the queries are collected to name the buckets to read; they are requests, not rows.
    """
    log = commits(spark, root)
    said = phrases(queries)
    asked = spark.createDataFrame(said.collect(), said.schema)
    terms = sorted({t for r in asked.collect() for t in r["terms"]})
    buckets = [r["b"] for r in asked.select(F.explode("terms").alias("t")).select(_bucket(F.col("t"), log[-1]["buckets"]).alias("b")).distinct().collect()]
    found = _read(spark, root, "postings", POSTING).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)) if terms else _read(spark, root, "postings", POSTING).limit(0)
    longest = max((len(r["terms"]) for r in asked.collect()), default=1)
    return score(_live(found, root, log), _live(_read(spark, root, "lengths", LENGTH), root, log), asked, longest > 1)


def read_chunks(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Chunks of tables of several schema versions as the newest one, by version: 1 has no ``pairs`` (made here from the text), 2 has them."""
    out = None
    for version in sorted(paths):
        df = spark.read.parquet(paths[version])
        if version not in (1, 2):
            raise ValueError(f"unknown schema version: {version}")
        df = df.select(*KEYS, "text", "heading", (cjk_bigrams(F.col("text")) if version == 1 else F.coalesce("pairs", cjk_bigrams(F.col("text")))).alias("pairs"))
        out = df if out is None else out.unionByName(df)
    return out
