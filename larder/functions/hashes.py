"""Canonical JSON, content hashes and fingerprints, as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(t: Column) -> Column:
    """UTC instant with Z; a fraction of six digits only where there is one."""
    seconds = F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(t) % 1000000
    return F.concat(seconds, F.when(micros == 0, F.lit("")).otherwise(F.format_string(".%06d", micros)), F.lit("Z"))


def iso_micros(t: Column) -> Column:
    """UTC instant with six digits of fraction and Z."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_text(s: Column) -> Column:
    """A JSON string literal (other scripts unescaped), or ``null``."""
    body = F.to_json(F.struct(s.alias("a")))
    return F.when(s.isNull(), F.lit("null")).otherwise(F.substring(body, F.lit(6), F.length(body) - 6))


def json_list(items: Column, sep: str = ", ") -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_text), sep), F.lit("]"))


def json_object(fields: dict[str, Column], sep: str = ", ", colon: str = ": ") -> Column:
    """Object with sorted keys; values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}"{colon}'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(sep, *parts), F.lit("}"))


_HASHED = ("author", "body", "canonical_url", "platform", "source_id", "title")


def content_hash() -> Column:
    """SHA-256 of an item's canonical JSON, over the item's columns; ``published_at`` is a timestamp."""
    fields = {c: json_text(F.col(c)) for c in _HASHED} | {"published_at": json_text(iso_utc(F.col("published_at")))}
    return F.sha2(json_object(fields), 256)


def batch_item() -> Column:
    """Compact canonical JSON of an item for a batch's fingerprint."""
    fields = {c: json_text(F.col(c)) for c in (*_HASHED, "extractor_version")}
    fields |= {c: json_text(iso_utc(F.col(c))) for c in ("observed_at", "published_at")} | {"collections": json_list(F.col("collections"), ",")}
    return json_object(fields, ",", ":")


def batch_fingerprint(items: Column, scans: Column | None = None) -> Column:
    """SHA-256 of a batch: its items' JSON in order and, for scoped batches, a map from scope to the ids scanned."""
    body = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if scans is None:
        return F.sha2(body, 256)
    scoped = F.transform(F.array_sort(F.map_entries(scans)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_list(F.array_sort(e["value"]), ",")))
    return F.sha2(F.concat(F.lit('{"items":'), body, F.lit(',"scope_scans":{'), F.array_join(scoped, ","), F.lit("}}")), 256)


def _sized(s: Column) -> Column:
    return F.concat(F.lpad(F.hex(F.octet_length(s).cast("long")), 16, "0"), F.hex(F.encode(s, "UTF-8")))


def fingerprint(files: Column) -> Column:
    """SHA-256 over (path, text) in order, each preceded by its length in eight bytes."""
    return F.sha2(F.unhex(F.array_join(F.transform(files, lambda f: F.concat(_sized(f["path"]), _sized(f["text"]))), "")), 256)


def tagged_hash(tag: str, *parts: Column) -> Column:
    """SHA-256 of the tag and the parts, parted by NUL characters: names of embedding tasks and profiles."""
    nul = F.lit("\0")
    return F.sha2(F.concat(F.lit(tag), *[x for p in parts for x in (nul, p)]), 256)
