"""Corpus preparation: five stages over ``documents``, each a DataFrame written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import decontam, language, lines, mixing, near_dup
from larder.llm.common import cut, fold, spare, table


def _beside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like an operator's new ones renamed, and the names its columns go by now."""
    away = {c: spare(docs, c) for c in docs.columns if c.lower() in made}
    return docs.withColumnsRenamed(away), {c: away.get(c, c) for c in docs.columns}


def _back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(now).alias(c) for c, now in names.items()])


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; null, empty and letterless texts go. Null ids, repeated rows and clashing columns are kept as they are."""
    model = language.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    apart, names = _beside(docs, ("lang_", "lang_score_", "lang_rejected_"))
    return _back(language.predict(apart, model).where("not lang_rejected_"), names)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more; ``n_chars`` follows the text where lines went. All rows stay, a null text as the empty one; ids and other columns are not read."""
    apart, names = _beside(docs, ("n_lines_", "n_dropped_"))
    out = lines.dedup_lines(apart)
    if "n_chars" in names:
        changed = F.when(F.col("n_dropped_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return _back(out, names)


def minhash_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that of least id (null ids last); texts without words all stay.

    Rows are told apart by a key that is written once, so null and repeated ids do no harm. Shingles have five words, as
    all stages on word shingles take; two words, as op7's own contract says, would also join texts that share many common pairs.
    """
    key = spare(docs, "_row_key")
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    keep = near_dup.near_dups(keyed, key=key).where("kept").select(key)
    return keyed.join(keep, key, "left_semi").select(*docs.columns)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty texts stay, ids and other columns are not read."""
    apart, names = _beside(docs, ("bench_items_", "bench_overlap_"))
    return _back(decontam.decontaminate(apart, table(spark, sf_dir, "benchmark")).where("bench_items_ = 0"), names)


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document that is left: one row per row, null ids and sources too."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs
