"""Messages of a browser extension: envelopes checked to any depth, and events routed to the parsers of their platform, with a code where one is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources import variant as v

# The protocol's version, limits, message types and keys, and names that would mean credentials.
VERSION = 1
MAX_MESSAGE, MAX_TEXT, MAX_REQUEST_ID = 8 * 1024 * 1024, 2 * 1024 * 1024, 64
TYPES = ("session.claim", "session.heartbeat", "session.pause", "session.finish", "session.cancel", "scope.declare", "capture.response", "capture.bundle")
ENVELOPE = ("protocolVersion", "requestId", "type", "payload")
FORBIDDEN = ("cookie", "cookies", "authorization", "headers", "token", "bearer", "csrf", "ct0", "auth_token", "sessdata", "z_c0")
# The event kinds of each platform that is captured through a browser.
ROUTES = {"x": ("x.bookmarks_page",), "bilibili": ("bilibili.video_bundle",), "zhihu": ("zhihu.items_page",)}
SCOPED = ("bilibili", "zhihu")


def _parts(value: Column) -> Column:
    """The JSON text of a variant cut at its quotes: strings and keys stand at odd places, what is between them at even ones. An escaped character counts as one blank."""
    return F.split(F.regexp_replace(F.to_json(value), r"\\(?:u[0-9A-Fa-f]{4}|.)", " "), '"')


def _is_key(parts: Column, i: Column) -> Column:
    return (i % 2 == 1) & F.startswith(F.get(parts, i + 1), F.lit(":"))


def keys(value: Column) -> Column:
    """All keys of a variant, however deep."""
    return F.transform(F.array(_parts(value)), lambda p: F.filter(F.transform(p, lambda x, i: F.when(_is_key(p, i), x)), lambda x: x.isNotNull()))[0]


def longest_text(value: Column) -> Column:
    """Bytes of the longest string of a variant that is no key, however deep."""
    return F.transform(F.array(_parts(value)), lambda p: F.array_max(F.transform(p, lambda x, i: F.when((i % 2 == 1) & ~_is_key(p, i), F.octet_length(x)).otherwise(0))))[0]


def credential_like(key: Column) -> Column:
    """Whether a key, or a part of it between other characters than letters and digits, is a forbidden name."""
    low = F.lower(key)
    return low.isin(*FORBIDDEN) | F.arrays_overlap(F.split(low, "[^a-z0-9]+"), F.array(*map(F.lit, FORBIDDEN)))


def decode(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """``messages`` with ``code`` (null for one that is accepted), ``request_id``, ``type`` and ``payload``, a variant.

    The first rule that fails names the code: the size of the whole, JSON that is an object of the four keys and no others, the version, request id and type, an object as payload, no key
    of it like a credential at any depth, and no string of it over two MiB. Each row is checked on its own, by expressions alone; null is no message.
    """
    m = messages.withColumn("_m", F.when(F.octet_length(raw) <= MAX_MESSAGE, v.decode(F.col(raw))))
    m = m.withColumn("_p", v.field(F.col("_m"), "$.payload"))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    unknown = F.size(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, ENVELOPE)))) == 0
    version, request, kind = v.whole(F.col("_m"), "$.protocolVersion"), v.text(F.col("_m"), "$.requestId"), v.text(F.col("_m"), "$.type")
    invalid = F.lit("invalid_message")
    code = (
        F.when(F.octet_length(raw) > MAX_MESSAGE, "message_too_large").when(bad(v.is_object(F.col("_m"))) | bad(unknown) | version.isNull(), invalid).when(version != VERSION, "protocol_mismatch")
        .when(request.isNull() | (F.length(request) > MAX_REQUEST_ID) | bad(kind.isin(*TYPES)) | bad(v.is_object(F.col("_p"))), invalid)
        .when(F.exists(keys(F.col("_p")), credential_like), "credential_field_rejected").when(longest_text(F.col("_p")) > MAX_TEXT, "message_too_large")
    )
    m = m.withColumn("code", code)
    ok = F.col("code").isNull()
    return m.select(*messages.columns, "code", F.when(ok, request).alias("request_id"), F.when(ok, kind).alias("type"), F.when(ok, F.col("_p")).alias("payload"))


def route(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """``events`` (session_id, job_id, session_platform, payload) with ``route`` (the kind), ``scope_id``, ``body`` (a variant) and ``code`` where an event is refused.

    An event must name its session's platform, a kind of that platform, and, on platforms with folders, a scope that its run has registered (``scopes``: job_id, platform, scope_id). A body comes as JSON text or decoded;
    text that is no JSON is a changed page. A refused event keeps its row.
    """
    p = F.col("payload")
    platform, kind, scope = v.text(p, "$.platform"), v.text(p, "$.kind"), v.text(p, "$.scopeId")
    given = v.field(p, "$.body")
    body = F.when(v.kind(given) == "STRING", v.decode(F.try_variant_get(p, "$.body", "string"))).otherwise(given)
    e = events.select("*", platform.alias("_platform"), kind.alias("_kind"), scope.alias("scope_id"), F.when(platform == "bilibili", v.field(p, "$.resource")).otherwise(body).alias("body"))
    known = F.create_map(*[x for name, kinds in ROUTES.items() for x in (F.lit(name), F.array(*map(F.lit, kinds)))])
    held = scopes.select("job_id", F.col("platform").alias("_platform"), "scope_id", F.lit(True).alias("_held")).distinct()
    e = e.join(held, ["job_id", "_platform", "scope_id"], "left")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    invalid = F.lit("invalid_message")
    code = (
        F.when(bad(F.col("_platform") == F.col("session_platform")) | bad(F.array_contains(known[F.col("_platform")], F.col("_kind"))), invalid)
        .when(F.col("_platform").isin(*SCOPED) & F.col("_held").isNull(), invalid).when(F.col("body").isNull(), "page_changed")
    )
    return e.withColumn("code", code).withColumn("route", F.when(F.col("code").isNull(), F.col("_kind"))).drop("_platform", "_kind", "_held")
