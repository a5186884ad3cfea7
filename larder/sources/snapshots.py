"""Snapshots of items: JSON records in folders by platform and bucket of the id, or one file an item as other tools leave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.hashes import content_hash, iso_utc
from larder.functions.markup import index_files
from larder.operators import validate
from larder.sources.variant import iso_instant

BUCKETS = 64
# The fields of an item that a fixture must have.
REQUIRED = ("platform", "source_id", "canonical_url", "title", "author", "published_at", "observed_at", "body", "collections", "extractor_version")
ASSET = "array<struct<relative_path string, media_type string, sha256 string, size_bytes bigint>>"
RECORD = f"""schema_version int, platform string, source_id string, canonical_url string, title string, author string, published_at string, observed_at string, body string,
collections array<string>, extractor_version string, content_hash string, platform_metadata variant, assets {ASSET}"""


def bucket(source_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(buckets)).cast("int")


def record(df: DataFrame) -> Column:
    """The snapshot of an item as JSON: folders distinct and sorted; metadata (JSON text) and assets only where the table has them and they are not empty."""
    fixed = F.struct(
        F.lit(1).alias("schema_version"), "platform", "source_id", "canonical_url", "title", "author", iso_utc(F.col("published_at")).alias("published_at"), iso_utc(F.col("observed_at")).alias("observed_at"),
        "body", F.array_sort(F.array_distinct("collections")).alias("collections"), "extractor_version", content_hash().alias("content_hash"),
    )
    base = F.to_json(fixed, {"ignoreNullFields": "false"})
    more = []
    if "platform_metadata" in df.columns:
        more.append(F.when(~F.coalesce(F.col("platform_metadata").isin("", "{}", "null"), F.lit(True)), F.concat(F.lit('"platform_metadata":'), "platform_metadata")))
    if "assets" in df.columns:
        asset = F.transform("assets", lambda a: F.struct(a["relative_path"].alias("relative_path"), a["media_type"].alias("media_type"), a["sha256"].alias("sha256"), F.octet_length(a["text"]).alias("size_bytes")))
        more.append(F.when(F.size("assets") > 0, F.concat(F.lit('"assets":'), F.to_json(asset))))
    return F.concat(F.concat_ws(",", F.left(base, F.length(base) - 1), *more), F.lit("}"))


def write(items: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Write the snapshots of ``items`` as JSON lines under platform and bucket; folders that hold none of them stay.

    A folder that holds one of them is written anew, so pass all items of a bucket, as ``replace`` does.
    """
    rows = items.select("platform", bucket(F.col("source_id"), buckets).alias("bucket"), record(items).alias("value"))
    # A file for each platform and bucket and up to four tasks, so that a large platform is not one task.
    dealt = rows.repartition("platform", "bucket", F.pmod(F.xxhash64("value"), F.lit(4)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("platform", "bucket").text(root)


def _checked(raw: DataFrame) -> DataFrame:
    """Rows with ``errors``: ``corrupt`` for a file or line that is no record, else those of ``validate.snapshots``; instants as timestamps."""
    bad = F.col("corrupt").isNotNull() | F.col("platform").isNull() & F.col("source_id").isNull() & F.col("schema_version").isNull()
    rows = raw.withColumn("published_at", iso_instant(F.col("published_at"))).withColumn("observed_at", iso_instant(F.col("observed_at")))
    # Assets are held without their texts here.
    got = validate.snapshots(rows.withColumnRenamed("assets", "_assets")).withColumnRenamed("_assets", "assets")
    return got.withColumn("errors", F.when(bad, F.array(F.lit("corrupt"))).otherwise(F.col("errors")))


def read(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots that ``write`` left, with ``errors`` and the ``bucket`` they lie in."""
    raw = spark.read.schema(f"{RECORD}, corrupt string, bucket int").option("columnNameOfCorruptRecord", "corrupt").json(root)
    return _checked(raw)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files ``<platform>/<id>/source.json`` below ``root``, one row each, with ``file_path`` and ``errors``; a folder that does not name its item is an error."""
    files = spark.read.schema(f"{RECORD}, corrupt string").option("recursiveFileLookup", True).option("pathGlobFilter", "source.json").option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(root)
    return _checked(files.withColumn("file_path", F.col("_metadata.file_path")))


def sound(rows: DataFrame) -> DataFrame:
    """Rows of a scan without errors; the first one with an error stops the job that reads them, with its file and errors."""
    at = F.coalesce(F.col("file_path"), F.concat_ws("/", "platform", "source_id")) if "file_path" in rows.columns else F.concat_ws("/", "platform", "source_id")
    stop = F.raise_error(F.concat(F.lit("snapshot "), at, F.lit(": "), F.array_join("errors", ", "))).cast("boolean")
    return rows.where(F.when(F.size("errors") == 0, True).otherwise(stop)).drop("errors", "corrupt")


def fixture(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array, with ``errors``: the fields that are missing or of another type, then those of ``validate.items``.

    A file that is no array, or an empty one, is an error of the call.
    """
    try:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.schema_of_variant(F.try_parse_json("value")).alias("kind"))
        first = whole.select("kind", F.size(F.try_variant_get("v", "$", "array<variant>")).alias("n")).first()
    except Exception as e:
        raise ValueError(f"unable to read fixture {path}") from e
    if first is None or not str(first["kind"]).startswith("ARRAY"):
        raise ValueError(f"fixture {path} must contain a JSON array")
    if not first["n"]:
        raise ValueError(f"fixture {path} must contain at least one item")
    rows = whole.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "v"))
    kind = lambda c: F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")), "^[A-Z]+(<STRING>|<VOID>)?", 0)
    text = lambda c: F.when(kind(c) == "STRING", F.try_variant_get("v", f"$.{c}", "string"))
    ok = {c: kind(c) == "STRING" for c in REQUIRED} | {"author": kind("author").isin("STRING", "VOID"), "collections": kind("collections").isin("ARRAY<STRING>", "ARRAY<VOID>")}
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), c) for c, good in ok.items()]))
    cols = [text(c).alias(c) for c in REQUIRED if c not in ("collections", "published_at", "observed_at")] + [iso_instant(text(c)).alias(c) for c in ("published_at", "observed_at")]
    got = validate.items(rows.select("pos", wrong.alias("wrong"), *cols, F.try_variant_get("v", "$.collections", "array<string>").alias("collections")))
    return got.withColumn("errors", F.array_distinct(F.concat("wrong", "errors"))).drop("wrong")


def find(spark: SparkSession, root: str, platform: str, source_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The snapshot of one item, from the one folder it can lie in; no row if there is none."""
    return find_all(spark, root, [(platform, source_id)], buckets)


def find_all(spark: SparkSession, root: str, keys: list[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """Snapshots of a request's items (platform, source_id), from their folders alone."""
    asked = spark.createDataFrame(keys, "platform string, source_id string")
    at = [(r["platform"], r["b"]) for r in asked.select("platform", bucket(F.col("source_id"), buckets).alias("b")).distinct().collect()]
    rows = read(spark, root).where(F.col("platform").isin(sorted({p for p, _ in at})) & F.col("bucket").isin(sorted({b for _, b in at})))
    return rows.join(F.broadcast(asked), ["platform", "source_id"], "left_semi")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(platform, source_id, path, text, place): the Markdown files of all items below ``root`` that are indexed; ``place`` orders those of an item."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").text(root, wholetext=True).select("value", "_metadata.file_path")
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    inside = F.split(F.substring_index("file_path", base + "/", -1), "/")
    rows = files.select(F.get(inside, F.lit(0)).alias("platform"), F.get(inside, F.lit(1)).alias("source_id"), F.array_join(F.slice(inside, 3, 1000), "/").alias("path"), F.col("value").alias("text"))
    return index_files(rows)


def get_item(snapshots: DataFrame, files: DataFrame, states: DataFrame, content: bool = False) -> DataFrame:
    """Snapshot, file list and state of each item in ``states`` (platform, source_id, access_status, content_type), available or not.

    ``files`` is (platform, source_id, path, text, place). The list is sorted and distinct, and always has ``source.json``; the texts come in order of ``place`` where ``content`` is asked for.
    An item without a snapshot has no row.
    """
    by = ["platform", "source_id"]
    one = F.struct("place", "path", *(["text"] if content else []))
    held = files.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("f"))  # the files of one item
    got = snapshots.join(states.select(*by, "access_status", "content_type"), by).join(held, by, "left")
    paths = F.coalesce(F.transform("f", lambda x: x["path"]), F.array().cast("array<string>"))
    out = got.withColumn("files", F.array_sort(F.array_distinct(F.concat(F.array(F.lit("source.json")), paths))))
    return (out.withColumn("content", F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text")))) if content else out).drop("f")

