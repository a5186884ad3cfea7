"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder that ``spark.checkpoint.dir`` names and read it back, which ends its lineage there.

    Without that setting only a local session (driver and tasks on one machine) gets a folder, its own; a cluster gets an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it: for helper columns beside those of a caller."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Words of the text, A-Z lower-cased; null and blank texts give an empty array."""
    text = F.regexp_replace(F.coalesce(lower_ascii(col), F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, f"{SPACE}+"))


def fold(col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % k


def per_class(rows: DataFrame, text: str, label: str, most: int) -> DataFrame:
    """Distinct (``text``, ``label``) of ``rows``, at most ``most`` of each label: those of least hash of the text.

    Copies count once, so neither they nor a frequent label crowd out another. Counts by label give a
    bound on the hash that a little more than ``most`` texts of the label fall under; only those are shuffled and
    ranked. A null label is dropped, a null text is one text.
    """
    h = rows.where(F.col(label).isNotNull()).select(text, label, F.xxhash64(text).alias("_o"))
    n = h.groupBy(label).agg(F.approx_count_distinct("_o", 0.02).alias("n"))
    least = n.select(F.col(label).alias("_l"), F.least(F.lit(1.0), (F.lit(1.25 * most) + 1000) / F.col("n")).alias("_p"))
    some = h.join(F.broadcast(least), F.col(label) == F.col("_l")).where(F.shiftrightunsigned("_o", 33) <= F.col("_p") * 2.0**31)
    some = some.groupBy(label, "_o").agg(F.first(text).alias(text))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.shiftrightunsigned("_o", 33), "_o"))
    return some.withColumn("_r", rank).where(F.col("_r") <= most).select(text, label, "_o")


_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """The words of ``words`` as UTF-8, for tasks: ``bytes.split`` parts at the same six characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split()


def hashes_of(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Hashes of repeated words come from a memo that is emptied when it is full.

    The memo hangs on the module ``xxhash``: functions travel to tasks by value, and each copy would keep one of its own.
    """
    memo = xxhash.__dict__.setdefault("_word_memo", {})
    if len(memo) > 100_000:
        memo.clear()
    for w in set(found).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w, 42)
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def free() -> None:
    """Give back what a finished block of a task has held, as the next task may run in the same process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
