"""Line dedup: drop lines whose normalised form occurs in many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import lower_ascii, spare, table

BLANKS = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    # In a line of ASCII alone ``lower`` changes A-Z and nothing else, in a fraction of the time of ``translate``.
    low = F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(lower_ascii(line))
    return F.trim(low, F.lit(BLANKS))


def _hash(line: Column) -> Column:
    """128 bits of the line's key; null for an empty key, which is never dropped."""
    key = _key(line)
    return F.when(F.length(key) > 0, F.unhex(F.md5(key.cast("binary"))))


def _in(found: Column, hashes: Column) -> Column:
    """Which of the hashes of a text's lines are among ``found``, as an array of flags.

    Few are looked up one by one. Many are first dealt to about as many lists as the root of their number, so n lines and n hashes take n^1.5 steps.
    """
    lists = F.ceil(F.sqrt(F.size(found))).cast("int")
    at = lambda h: F.pmod(F.xxhash64(h), lists)
    has = lambda some, h: F.coalesce(F.array_contains(some, h), F.lit(False))
    named = F.array(F.transform(found, lambda h: F.struct(at(h).alias("list"), h.alias("h"))))
    deal = lambda all_: F.transform(F.sequence(F.lit(0), lists - 1), lambda i: F.transform(F.filter(all_, lambda x: x["list"] == i), lambda x: x["h"]))
    dealt = F.transform(named, deal)
    many = F.transform(dealt, lambda some: F.transform(hashes, lambda h: has(F.get(some, at(h).cast("int")), h)))[0]
    return F.when(F.size(found) <= 64, F.transform(hashes, lambda h: has(found, h))).otherwise(many)


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, plus ``n_lines_`` and ``n_dropped_``.

    A row is a document: repeated rows and rows with null or repeated ids count each. A null or empty text is one empty line and
    comes back as the empty text. Empty keys are never dropped; a line in exactly ``min_docs`` documents is. An empty table gives no rows.
    The caller's columns keep their values, whatever their names; only columns named ``n_lines_`` and ``n_dropped_`` are replaced.
    Lines are exploded as 128-bit hashes, one per document and key, so a line in every document is counted before the shuffle;
    the join that finds common lines is inner, so AQE can split the partition of a hot line.
    A document is named in the shuffles by 128 bits of its whole text: equal texts lose equal lines.
    """
    made = ("n_lines_", "n_dropped_")
    docs = docs.drop(*made)
    name, set_, all_, left = (spare(docs, c) for c in ("_doc", "_drops", "_lines", "_kept"))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    doc = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    held = doc.select(F.col(name).alias("doc"), F.explode(F.array_distinct(F.transform(lines, _hash))).alias("h")).where("h is not null")
    common = held.groupBy("h").count().where(F.col("count") >= min_docs).select("h")
    # A set holds at most the distinct lines of one text, however many copies the text has.
    drops = held.join(common, "h").groupBy(F.col("doc").alias(name)).agg(F.collect_set("h").alias(set_))
    out = doc.join(drops, name, "left").withColumn(all_, lines)
    # The flags are bound once, beside the lines; the lines of a text without common ones are not hashed again.
    flags = F.array(_in(F.col(set_), F.transform(all_, _hash)))
    kept = F.transform(flags, lambda gone: F.filter(all_, lambda x, i: ~F.get(gone, i)))[0]
    out = out.withColumn(left, F.when(F.col(set_).isNull(), F.col(all_)).otherwise(kept))
    own = [(F.array_join(left, "\n").alias(c) if c == text else F.col(c)) for c in docs.columns]
    return out.select(*own, F.size(all_).cast("long").alias(made[0]), (F.size(all_) - F.size(left)).cast("long").alias(made[1]))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, i AS pos, s[i] AS line,
             translate(regexp_replace(s[i], '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY l.doc_id
"""
