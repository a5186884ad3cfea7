"""Inputs that several queries share, bound to the given tables."""

from pyspark.sql import functions as F

from larder import storage
from larder.operators import index, search
from larder.sources.binding import items, table

ASKED = [(1, "thou ertion"), (2, "eau the"), (3, "worthless clown")]


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, text string")


def index_rows(spark, sf, ok=None):
    """Index rows: the windows of every text, or of those of the items ``ok`` (doc_id), which are chosen before a text is cut; plain texts have no heading."""
    docs = table(spark, sf, "documents").where("text is not null")
    docs = docs if ok is None else docs.join(ok.select("doc_id"), "doc_id", "left_semi")
    return search.chunks(docs).withColumn("heading", F.lit(None).cast("string"))


_BUILT: dict[tuple, str] = {}


def stored_index(spark, sf) -> str:
    """The index of all windows of ``documents``, built on first use in a session and again when the table's files have changed."""
    files = table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row per file
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files)))
    if key not in _BUILT:
        root = storage.folder(spark, "index")
        index.build(index_rows(spark, sf), root)
        _BUILT[key] = root
    return _BUILT[key]


def lexical(spark, sf):
    return index.search(spark, stored_index(spark, sf), asked(spark))


def semantic(spark, sf, k=500):
    """Every vector whose id is divisible by 50 asks against all vectors, for its ``k`` best."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = v.where("doc_id % 50 = 0").select((F.col("doc_id") / 50 + 1).cast("int").alias("query_id"), F.col("v").alias("q"))
    return search.cosine(v, q, k)


def fused(spark, sf, limit=10, ok=None):
    """Both arms over the items that ``ok`` lets in; the vector of an item stands for its first chunk."""
    it = items(spark, sf)
    it = it if ok is None else it.join(ok, "doc_id", "left_semi")
    near = search.top(semantic(spark, sf).join(it.select("doc_id"), "doc_id", "left_semi"), 500).withColumn("ordinal", F.lit(0))
    return search.fuse(search.rank_lexical(lexical(spark, sf), it), near, it, limit)


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
