"""Typed reads of decoded JSON pages (VARIANT columns): a field of another type counts as missing."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(body: Column) -> Column:
    """JSON text as a variant; text that is not JSON, or goes on after it, gives null. (The parser alone stops at the end of the first value.)"""
    whole = F.concat(F.lit('{"a":'), body, F.lit(',"b":0}'))
    return F.when(F.size(F.json_object_keys(whole)) == 2, F.try_variant_get(F.try_parse_json(whole), "$.a", "variant"))


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """First word of the variant's schema: OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN or VOID; null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once. (Inside lambdas Spark computes an expression anew wherever it stands.)"""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_object(v: Column, path: str = "$") -> Column:
    """Whether there is an object. (Only an object can be read as a struct; neither a copy of it nor its schema is made.)"""
    return F.try_variant_get(v, path, "struct<a:boolean>").isNotNull()


def present(v: Column) -> Column:
    """Neither absent nor JSON null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def _typed(v: Column, path: str, schemas: tuple[str, ...], read: str) -> Column:
    return F.when(F.schema_of_variant(field(v, path)).isin(*schemas), F.try_variant_get(v, path, read))


def text(v: Column, path: str) -> Column:
    """A JSON string that is not blank."""
    return let(any_text(v, path), lambda s: F.when(F.trim(s, F.lit(" \t\n\x0b\x0c\r")) != "", s))


def any_text(v: Column, path: str) -> Column:
    """A JSON string, the empty one included."""
    return _typed(v, path, ("STRING",), "string")


def whole(v: Column, path: str) -> Column:
    """A JSON whole number; true and false are none."""
    return _typed(v, path, ("BIGINT",), "long")


def number(v: Column, path: str) -> Column:
    """A finite JSON number."""
    return F.when(kind(field(v, path)).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, path, "double"))


def flag(v: Column, path: str) -> Column:
    return _typed(v, path, ("BOOLEAN",), "boolean")


def entries(v: Column, path: str = "$") -> Column:
    """The elements of a JSON array; null if it is none."""
    return F.try_variant_get(v, path, "array<variant>")


def instant(seconds: Column) -> Column:
    """Epoch seconds, not negative, as a timestamp; anything else is null."""
    return F.when((seconds >= 0) & (seconds < 253402300800), F.timestamp_micros((seconds.cast("decimal(20,6)") * 1000000).cast("long")))


def bounded_instant(seconds: Column) -> Column:
    """Whole epoch seconds after 0 up to the start of 2100."""
    return F.when((seconds > 0) & (seconds <= 4102444800), F.timestamp_seconds(seconds))


def iso_instant(s: Column) -> Column:
    """ISO-8601 text with an offset or Z as a timestamp; text without an offset is null."""
    return F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(s))


def wire_date(s: Column) -> Column:
    """Dates such as ``Wed Oct 10 20:19:24 +0000 2018``; the weekday is not read."""
    return F.try_to_timestamp(F.regexp_extract(s, r"^[A-Z][a-z]{2} (.*)$", 1), F.lit("MMM dd HH:mm:ss Z yyyy"))
