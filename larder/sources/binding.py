"""Canonical tables of saved items, bound to the given Parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved item per document: platform, times, access status and content type follow from the id."""
    i = F.col("doc_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    published = F.lit(1704067200) + (i * 37 % 5000) * 60
    return table(spark, sf_dir, "documents").select(
        "doc_id", pick(4, "bilibili", "github", "x", "zhihu").alias("platform"), i.cast("string").alias("source_id"),
        F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.col("text").alias("body"), F.col("source").alias("author"),
        published.alias("published"), F.when(i % 5 != 0, published + (i % 11) * 86400).alias("favorited"),
        F.when(i % 17 == 0, "unavailable").otherwise("available").alias("access_status"), pick(3, "text", "video", "mixed").alias("content_type"),
    )


def item_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name): the folders an item is filed in."""
    by_source = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("name"))
    labels = table(spark, sf_dir, "labels")
    marks = [labels.where(f"{c} = 1").select("doc_id", F.lit(c).alias("name")) for c in ("quality", "toxic")]
    return by_source.union(marks[0]).union(marks[1])


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index tasks: one per document, named by the hash of its text."""
    i = F.col("doc_id")
    status = F.when(i % 13 == 0, "pending").otherwise("completed")
    created = F.lit(1704067200) + (i * 37 % 5000) * 60
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("index_content").alias("kind"), F.sha2("text", 256).alias("input_hash"), status.alias("status"), created.alias("created"))
