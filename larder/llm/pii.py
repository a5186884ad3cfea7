"""PII: pattern spans plus terms that reveal them, judged by corpus co-occurrence."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, table

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A start inside a digit run fails wherever the run's own start failed, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
#: Terms that are broadcast at most; more are joined instead.
MOST_TERMS = 50_000
#: Bits of the bitmap for more terms, as a power of two.
BITS = 25
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; linear in the text."""
    t, out, last = text or "", [], 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(t):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _entity(text: str, kind: int, start: int, end: int) -> int:
    """Hash of the value protected, equal for one number written in several ways."""
    raw = text[start:end]
    value = re.sub("[^0-9]", "", raw) if kind > 1 else raw.lower()
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def _outside(text: str, spans) -> tuple[list, list]:
    """(spans by start, words that meet none of them)."""
    cover = sorted((s, e, k) for k, s, e in spans)
    begin, end = [], []  # spans that meet, merged
    for s, e, _ in cover:
        if end and s <= end[-1]:
            end[-1] = max(end[-1], e)
        else:
            begin.append(s)
            end.append(e)

    def free_of(m) -> bool:
        i = bisect_left(begin, m.end())  # merged spans from i on begin at or after the word's end
        return i == 0 or end[i - 1] <= m.start()

    return cover, [m for m in _WORD.finditer(text) if free_of(m)]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = 2, bits: float = 3.0, least: int = 20, share: float = 0.25, single: int = 3) -> DataFrame:
    """(id, text, spans, clean_text) per row of ``docs``.

    Pattern spans are found first. Every word outside them (letters, lower-cased) counts in the corpus, and
    counts again where it stands within ``reach`` words of a protected span: once for spans of
    any value, and once for each value it stands near. A word reveals if it
    stands near spans at least ``least`` times, or near one value at least ``single`` times, in at least ``share``
    of its uses, and the log2 ratio of that share to the corpus share (of spans, or of that value) is at least
    ``bits``. All its uses outside pattern spans, in every text, become ``term`` spans. In
    ``clean_text`` pattern spans generalise to ``<kind>`` and terms are removed as ``<term>``.
    A null or empty text has no spans and comes back as the empty text; repeated rows and repeated or null ids are
    rows of their own and count each. An empty table gives no rows. Terms at a threshold reveal. Only the two named columns are read, so others cannot clash.
    """

    def near_words(t: str, cover: list, words: list):
        """(term, position, entity) of the words near each span."""
        starts = [m.start() for m in words]
        for s, e, k in cover:
            i, j = bisect_left(starts, s), bisect_left(starts, e)
            v = _entity(t, k, s, e)
            for x in {*range(max(0, i - reach), i), *range(j, min(len(words), j + reach))}:
                yield words[x].group().lower(), x, v

    def tally(batches):
        for b in batches:
            n, near, pairs = Counter(), Counter(), Counter()
            for t in b["_text"]:
                spans = base_spans(t)
                cover, words = _outside(t, spans) if spans else ([], ())
                n.update(m.group() for m in words) if spans else n.update(_WORD.findall(t))
                found = list(near_words(t, cover, words))
                near.update(w for w, _ in {(w, x) for w, x, _ in found})
                pairs.update((w, v) for w, _, v in {*found})
            low = Counter()
            for w, k in n.items():
                low[w.lower()] += k
            kinds = {"term": "object", "entity": "Int64", "n": "int64", "n_near": "int64"}
            yield pd.DataFrame({"term": list(low), "entity": None, "n": list(low.values()), "n_near": [near[w] for w in low]}).astype(kinds)
            yield pd.DataFrame({"term": [w for w, _ in pairs], "entity": [v for _, v in pairs], "n": 0, "n_near": list(pairs.values())}).astype(kinds)

    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    every = src.select("_text").mapInPandas(tally, "term string, entity long, n long, n_near long").groupBy("term", "entity").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"))
    every = cut(every)
    pairs, every = every.where(F.col("entity").isNotNull()).drop("n"), every.where(F.col("entity").isNull()).drop("entity")
    seen = every.where(F.col("n_near") >= least)
    total, close = every.agg(F.sum("n"), F.sum("n_near")).first()
    base = (close or 0) / max(1, total or 0)
    rate = F.col("n_near") / F.col("n")
    reveals = seen.where((rate >= share) & (F.log2(rate / F.lit(max(base, 1e-12))) >= bits)).select("term")
    tied = pairs.where(F.col("n_near") >= single).join(every.select("term", "n"), "term").where(rate >= share)
    tied = tied.join(pairs.groupBy("entity").agg(F.sum("n_near").alias("n_entity")), "entity")
    tied = tied.where(F.log2(rate * F.lit(max(1, total or 0)) / F.col("n_entity")) >= bits).select("term")
    reveals = cut(reveals.union(tied).distinct())
    few = reveals.limit(MOST_TERMS + 1).toPandas()["term"]
    known = docs.sparkSession.sparkContext.broadcast(frozenset(few)) if len(few) <= MOST_TERMS else None

    def uses(t: str, spans, terms):
        """Spans of the uses of ``terms`` outside ``spans``."""
        if terms.isdisjoint(w.lower() for w in {*_WORD.findall(t)}):
            return []
        return [(4, m.start(), m.end()) for m in _outside(t, spans)[1] if m.group().lower() in terms]

    if known is not None:

        def mark(texts: pd.Series) -> pd.Series:
            found = ((t, base_spans(t)) for t in texts)
            return pd.Series([spans + uses(t, spans, known.value) for t, spans in found], dtype="object")

        out = src.withColumn("spans", F.pandas_udf(mark, _SPANS)("_text"))
    else:  # too many terms to broadcast: a bitmap of fixed size picks the words that are joined to them
        slot = F.shiftrightunsigned(F.xxhash64("term"), 64 - BITS)
        ones = reveals.select(F.shiftright(slot, 3).alias("i"), F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)).cast("int")).alias("b"))
        ones = ones.groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
        bitmap = np.zeros((1 << BITS) // 8, np.uint8)
        bitmap[ones["i"].to_numpy(dtype=np.int64)] = ones["b"].to_numpy(dtype=np.uint8)
        held = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

        def likely(texts: pd.Series) -> pd.Series:
            def on(w):
                at = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) >> (64 - BITS)
                return held.value[at >> 3] >> (at & 7) & 1

            return pd.Series([[w for w in {w.lower() for w in _WORD.findall(t)} if on(w)] for t in texts], dtype="object")

        def mark(texts: pd.Series, terms: pd.Series) -> pd.Series:
            found = ((t, base_spans(t), frozenset(() if w is None else w)) for t, w in zip(texts, terms))
            return pd.Series([spans + uses(t, spans, w) for t, spans, w in found], dtype="object")

        row = F.xxhash64("_id", "_text")
        hits = src.select(row.alias("_row"), F.explode(F.pandas_udf(likely, "array<string>")("_text")).alias("term")).distinct().join(reveals, "term")
        hits = hits.groupBy("_row").agg(F.collect_set("term").alias("_terms"))
        out = src.withColumn("_row", row).join(hits, "_row", "left").withColumn("spans", F.pandas_udf(mark, _SPANS)("_text", "_terms"))
        out = cut(out.select("_id", "_text", "spans"))
    out = out.withColumn("spans", F.array_sort("spans"))

    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        done = []
        for t, ss in zip(texts, spans):
            parts, at = [], 0
            for k, s, e in sorted(((x["kind"], x["start"], x["end"]) for x in ss), key=lambda x: (x[1], x[0])):
                if s >= at:
                    parts += [t[at:s], f"<{KINDS[k]}>"]
                at = max(at, e)
            done.append("".join(parts) + t[at:])
        return pd.Series(done)

    cleaned = F.when(F.size("spans") == 0, F.col("_text")).otherwise(F.pandas_udf(clean, "string")("_text", "spans"))
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), "spans", cleaned.alias("clean_text"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(show(base).cast("binary"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"), n("term"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))
