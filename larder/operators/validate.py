"""Validation: every row gets the array of its errors, so that bad rows are counted and kept apart, not lost."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fields as f
from larder.functions.hashes import content_hash


def _errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a null test does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def _unique(array: Column) -> Column:
    return F.coalesce(F.size(array) == F.size(F.array_distinct(array)), F.lit(True))


def asset_errors(a: Column) -> Column:
    """Errors of one asset (relative_path, media_type, text, sha256)."""
    path, text = a["relative_path"], a["text"]
    parts = F.split(path, "/")
    return _errors({
        "path": path.isNotNull() & ~path.rlike(r"\A[/\\]|[\\:]") & F.forall(parts, f.safe_id), "root": parts[0].isin(*f.ASSET_ROOTS), "name": F.size(parts) >= 2,
        "media_type": a["media_type"].isin(*f.ASSET_TYPES), "size": F.octet_length(text) <= f.MAX_ASSET, "sha256": F.sha2(text, 256) == a["sha256"],
    })


def items(df: DataFrame) -> DataFrame:
    """``errors`` of captured items; optional columns (roots, assets) are checked where the table has them."""
    has = lambda c: c in df.columns
    rules = {
        "platform": F.col("platform").isin(*f.PLATFORMS), "source_id": f.safe_id(F.col("source_id")), "canonical_url": f.http_url(F.col("canonical_url")),
        "published_at": F.col("published_at").isNotNull(), "observed_at": F.col("observed_at").isNotNull(), "title": ~f.blank(F.col("title")), "extractor_version": ~f.blank(F.col("extractor_version")),
    }
    if has("authoritative_asset_roots"):
        rules["roots"] = F.size(F.array_except(F.coalesce("authoritative_asset_roots", F.array().cast("array<string>")), F.array(*map(F.lit, f.ASSET_ROOTS)))) == 0
    if has("assets"):
        rules["assets"] = ~F.coalesce(F.exists("assets", lambda a: F.size(asset_errors(a)) > 0), F.lit(False))
        rules["asset_paths"] = _unique(F.transform("assets", lambda a: a["relative_path"]))
    return df.withColumn("errors", _errors(rules))


def enrichments(df: DataFrame) -> DataFrame:
    """``errors`` of enrichment blocks (summary, tags, content_type, provider, model, input_hash, generated_at as ISO text)."""
    name = lambda c: ~f.blank(F.col(c)) & (F.length(c) <= 200)
    stamp = F.col("generated_at")
    rules = {
        "summary": ~f.blank(F.col("summary")) & (F.length("summary") <= 2000), "tag_count": F.size("tags").between(1, 8),
        "tags": F.forall("tags", lambda t: ~f.blank(t) & (F.length(t) <= 40)), "tags_unique": _unique(F.transform("tags", f.casefold)),
        "content_type": F.col("content_type").isin("text", "video", "image", "mixed"), "provider": name("provider"), "model": name("model"), "input_hash": name("input_hash"),
        "generated_at": F.try_to_timestamp(stamp).isNotNull() & stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$"),
    }
    return df.withColumn("errors", _errors(rules))


def snapshots(df: DataFrame) -> DataFrame:
    """``errors`` of stored snapshots: those of items, the schema version, the stored hash, and that the folder names the item."""
    got = items(df)
    more = {"schema_version": F.col("schema_version") == 1, "content_hash": F.col("content_hash") == content_hash()}
    if "file_path" in df.columns:
        more["folder"] = F.col("file_path").endswith(F.concat(F.lit("/"), "platform", F.lit("/"), "source_id", F.lit("/source.json")))
    return got.withColumn("errors", F.concat("errors", _errors(more)))


def unknown_keys(body: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not allowed."""
    return F.array_except(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def scan_limits(df: DataFrame) -> DataFrame:
    """``errors`` of scan arguments (items, scopes: map from scope to ids, frontier): sizes and unique ids."""
    ids = F.map_values("scopes")
    rules = {
        "items": F.size("items") <= 50, "item_ids": _unique(F.col("items")), "scopes": F.size("scopes") <= 100, "frontier": F.size("frontier") <= 100,
        "scope_ids": F.forall(ids, lambda x: (F.size(x) <= 200) & _unique(x)), "flat": F.col("platform").isin(*f.SCOPED) | (F.size("scopes") == 0),
    }
    return df.withColumn("errors", _errors(rules))


def jobs(df: DataFrame) -> DataFrame:
    """``errors`` of job requests (platforms, mode, since, until, cap, scopes)."""
    rules = {
        "platforms": (F.size("platforms") > 0) & _unique(F.col("platforms")) & F.forall("platforms", lambda p: p.isin(*f.PLATFORMS)), "mode": F.col("mode").isin("full", "incremental"),
        "range": F.coalesce(F.col("since") <= F.col("until"), F.lit(True)), "cap": F.coalesce(F.col("cap") >= 1, F.lit(True)), "scopes": (F.size(F.coalesce("scopes", F.array().cast("array<string>"))) == 0) | (F.size("platforms") == 1),
    }
    return df.withColumn("errors", _errors(rules))
