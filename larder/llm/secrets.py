"""Secret scan over an incremental ledger of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, table

#: Kind, version, pattern, group whose length counts, least length.
RULES = (
    ("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _running(sizes: Column) -> Column:
    """Sums of an array of whole numbers up to each place.

    A sum that appends to one array copies it at each step; here runs of about the root of the length are summed, then the runs' totals, so n numbers take n^1.5 copies.
    """
    n = F.size(sizes)
    run = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    ints = F.array().cast("array<int>")
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))
    within = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), lambda i: F.aggregate(F.slice(sizes, i * run + 1, run), ints, step))

    def whole(runs):
        before = F.aggregate(F.transform(runs, lambda r: F.get(r, F.size(r) - 1)), ints, step)
        return F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.coalesce(F.get(before, i - 1), F.lit(0)))))

    return F.when(n > 0, F.transform(F.array(within), whole)[0]).otherwise(ints)


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Code-point spans of the matches: what split leaves between them, and their own lengths, give where each ends."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), sized.alias("val"))
    none = F.array().cast(_SPAN)
    # All that is summed is bound once: a match and the gap ahead of it.
    bound = F.transform(F.array(F.filter(parts, lambda p: p["hit"].isNotNull())), lambda ps: F.arrays_zip(ps.alias("p"), _running(F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["hit"]))).alias("end")))[0]
    good = F.filter(bound, lambda x: F.length(x["p"]["val"]) >= least)
    span = lambda x: F.struct((x["end"] - F.length(x["p"]["hit"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    return F.when(text.rlike(pattern), F.transform(good, span).cast(_SPAN)).otherwise(none)


def _named(versions: DataFrame, path: str, content: str) -> DataFrame:
    v = versions.select(F.col(path).alias("_path"), F.coalesce(F.col(content), F.lit("")).alias("_text"))
    return v.withColumn("blob", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))


def scan_blobs(versions: DataFrame, path: str, content: str, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, spans) of the versions (path, content).

    Blobs are named by the SHA-256 of their content; a null content is the empty blob. Only pairs of blob and rule
    version that ``ledger`` lacks are scanned, each once however many paths and copies hold the blob: copies collapse
    map-side before the shuffle. A blob without findings gets its rows too, with no spans. An empty table gives no rows; only the named columns are read.
    """
    blobs = _named(versions, path, content).groupBy("blob").agg(F.first("_text").alias("_text"))
    if ledger is None:
        blobs = blobs.withColumn("_seen", F.array().cast("array<string>"))
    else:
        old = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("_seen"))
        blobs = blobs.join(old, "blob", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
    made = []
    for i, (kind, version, pattern, group, least) in enumerate(rules):
        new = ~F.array_contains("_seen", f"{kind}@{version}")
        spans = F.when(new, _spans(F.col("_text"), i, kind, pattern, group, least))
        made.append(F.struct(F.lit(kind).alias("rule"), F.lit(version).alias("version"), new.alias("new"), spans.alias("spans")))
    return blobs.select("blob", F.explode(F.array(*made)).alias("m")).where("m.new").select("blob", "m.rule", "m.version", "m.spans")


def findings(versions: DataFrame, path: str, content: str, ledger: DataFrame, rules=RULES) -> DataFrame:
    """(path, blob, spans) per row of ``versions``: what ``ledger`` holds for its blob under these rules, by start.

    Nothing is scanned. Only blobs with findings are joined; versions of other blobs have no spans. Repeated and null paths are rows
    of their own; a blob the ledger has not seen has no spans.
    """
    now = F.concat_ws("@", "rule", F.col("version").cast("string")).isin(*[f"{k}@{v}" for k, v, *_ in rules])
    hits = ledger.where(now & (F.size("spans") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    back = _named(versions, path, content).select("_path", "blob").join(hits, "blob", "left")
    return back.select(F.col("_path").alias(path), "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All rows of ``documents`` arrive in two increments; the second reads the ledger that the first wrote."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    ledger = cut(scan_blobs(docs.where(~late), "doc_id", "text"))
    ledger = ledger.union(cut(scan_blobs(docs.where(late), "doc_id", "text", ledger)))
    found = findings(docs, "doc_id", "text", ledger)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))
