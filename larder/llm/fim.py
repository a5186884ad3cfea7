"""Fill in the middle: texts cut at line ends found by rank and select over packed boundary bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import spare, table

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class Boundaries:
    """The line ends of a UTF-8 text as a bitvector: bit i is set if a unit ends with byte i.

    Eight bits to a byte, and a directory of the bits set before each block of ``BLOCK`` bytes, so an
    answer reads the directory and one block. It takes an eighth of the text, and an eighth of that again.
    """

    BLOCK = 64

    def __init__(self, text: bytes):
        ends = np.frombuffer(text, np.uint8) == 10
        if len(ends) and not ends[-1]:  # a last line without a line break is a unit too
            ends = np.r_[ends[:-1], True]
        self.bits = np.packbits(ends)
        ones = _ONES[np.pad(self.bits, (0, -len(self.bits) % self.BLOCK))].reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.r_[0, np.cumsum(ones)]

    def __len__(self) -> int:
        """Units of the text: the popcount of all bits."""
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """Bytes of the first ``rank`` units."""
        if rank == 0:
            return 0
        block = int(np.searchsorted(self.before, rank)) - 1  # the last block with fewer bits before it
        at = block * self.BLOCK
        places = np.flatnonzero(np.unpackbits(self.bits[at : at + self.BLOCK]))
        return at * 8 + int(places[rank - 1 - self.before[block]]) + 1

    def rank(self, size: int) -> int:
        """Units that end within the first ``size`` bytes."""
        block = size // 8 // self.BLOCK
        part = np.unpackbits(self.bits[block * self.BLOCK : -(-size // 8)])
        return int(self.before[min(block, len(self.before) - 1)]) + int(part[: size - block * self.BLOCK * 8].sum())


def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Units of each text, and the bytes of its prefix and of its prefix and middle."""
    out = []
    for text, *draws in zip(texts, first, second):
        b = Boundaries(text)
        low, high = sorted(d % (len(b) + 1) for d in draws)
        out.append((len(b), b.select(low), b.select(high)))
    return pd.DataFrame(out, columns=["n", "a", "b"], dtype="int64")


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", salt: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``fim_`` columns: ``fim_n_`` units, ``fim_form_``, ``fim_prefix_``, ``fim_middle_``, ``fim_suffix_`` and ``fim_output_``.

    A unit is a line with its line break, or a last line without one. Two draws from SHA-256 of ``salt``:id pick how many units come before
    the cuts, a third whether the text is changed (``rate`` in 100), a fourth whether the suffix goes first (spm, ``spm`` in 100) or the prefix (psm).
    Empty and null texts (null counts as empty) and texts that hold a mark stay plain: their parts are null and the output is the text. A cut may
    leave any part empty. A null id draws as the empty one; rows of equal id and text get equal results, and an empty table no rows.
    A text of any length is read whole, in one row of a task. Columns of the ``fim_`` names are replaced, others are kept.
    """
    made = ("fim_n_", "fim_form_", "fim_prefix_", "fim_middle_", "fim_suffix_", "fim_output_")
    docs = docs.drop(*made)
    raw_, hash_, cut_ = (spare(docs, c) for c in ("_raw", "_hash", "_cut"))
    raw, digest = F.col(raw_), F.col(hash_)
    df = docs.withColumn(raw_, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    df = df.withColumn(hash_, F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    df = df.withColumn(cut_, F.pandas_udf(_cuts, "n long, a long, b long")(raw, _draw(digest, 0), _draw(digest, 1)))
    a, b = F.col(cut_)["a"].cast("int"), F.col(cut_)["b"].cast("int")
    plain = (F.octet_length(raw) == 0) | F.col(text).rlike(_MARK) | (_draw(digest, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(digest, 3) % 100 < spm, "spm").otherwise("psm")
    df = df.withColumn("fim_n_", F.col(cut_)["n"]).withColumn("fim_form_", form)
    part = lambda start, size: F.when(F.col("fim_form_") != "plain", F.substring(raw, start + 1, size).cast("string"))
    df = df.withColumns({"fim_prefix_": part(F.lit(0), a), "fim_middle_": part(a, b - a), "fim_suffix_": part(b, F.octet_length(raw) - b)})
    p, s, m = F.col("fim_prefix_"), F.col("fim_suffix_"), F.col("fim_middle_")
    psm, spm_ = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m), F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(F.col("fim_form_") == "psm", psm).when(F.col("fim_form_") == "spm", spm_).otherwise(raw.cast("string"))
    return df.withColumn("fim_output_", output).drop(raw_, hash_, cut_)


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form alone. A text with a mark of its own is plain, so the marks found here are the ones put in."""
    part = F.split(output, _MARK, -1)
    at = lambda *order: F.concat(*[part[i] for i in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.length(c).cast("long")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("fim_n_").alias("n"), F.col("fim_form_").alias("form"), size("fim_prefix_").alias("prefix_chars"), size("fim_middle_").alias("middle_chars"),
        sha(F.col("fim_output_")).alias("output_sha256"), sha(restore(F.col("fim_output_"), F.col("fim_form_"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(l) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM u),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
