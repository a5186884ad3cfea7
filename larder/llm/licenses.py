"""License scan: word k-grams of texts joined to places in templates, votes summed by diagonal."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import lower_ascii, spare, table

#: What stands between words, and the phrases of the contract with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: More phrases, which count only as they stand, with their labels.
VARIANTS = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu general public license v2": "gpl-2.0", "gnu general public license v3": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "apache license version 2 0": "apache-2.0", "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by",
    "spdx license identifier mit": "mit", "spdx license identifier apache 2 0": "apache-2.0", "spdx license identifier gpl": "gpl", "spdx license identifier bsd": "bsd",
}

#: Notices in general use; one counts where most of it stands, words put in, left out or changed.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under the creative commons attribution": "cc-by",
}

SHORT, LONG = 2, 4
MOST_GRAMS = 20_000  # of templates that are broadcast, some 2 MB
_SPAN = "array<struct<start:long,end:long,label:string,phrase:string,score:double>>"


def words(text: Column) -> Column:
    """Words of a text, as written. (Extracting them by a pattern copies the text for each match.)"""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda x: x != "")


def template_grams(phrases: Mapping[str, str], notices: Mapping[str, str]) -> list[tuple]:
    """(gram, template, label, phrase, size, grams, at): where each gram stands in each template; phrases go by two words, notices by four."""
    rows = []
    for exact, templates in ((True, phrases), (False, notices)):
        for i, (name, label) in enumerate(templates.items()):
            w, k = name.split(), SHORT if exact else LONG
            if len(w) < k:
                raise ValueError(f"a template needs {k} words: {name!r}")
            n = len(w) - k + 1
            rows += [(" ".join(w[j : j + k]), f"{'phrase' if exact else 'notice'} {i}", label, name if exact else None, k, n, j) for j in range(n)]
    return rows


def find_licenses(docs: DataFrame, text: str = "text", phrases: Mapping[str, str] | None = None, notices: Mapping[str, str] | None = None, least: float = 0.6, slack: int = 8) -> DataFrame:
    """``docs`` with ``license_words_`` (words of the text) and ``license_spans_``: (start, end, label, phrase, score), by start, in words from 0, end exclusive.

    The rolling grams of two and of four words of every text meet the grams of the templates by hash and then by their
    words, so a vote is never a collision; a gram whose first word begins no gram of a template can meet none and stays behind. Votes of a text and template are gathered by diagonal (place in the text less place in the template). A phrase counts where one diagonal
    holds all its grams, which means that its words stand there one after the other; score 1. For a notice, diagonals no more than ``slack`` apart are
    merged, as words put in or left out move the rest to a neighbour; it counts if the merged ones hold at least ``least`` of its grams within a span of no more than its words
    and half as many again. Its score is that share, and its phrase is null.

    A null text counts as empty and has no words; texts with fewer words than a gram have no votes. A text is named in the shuffles by 128 bits of it:
    equal texts have equal spans, so copies collapse before the shuffle, and null or repeated ids do no harm. A text of any length is split whole in one row; its
    grams leave it one by one, and what is gathered of a text are its spans. Templates are broadcast up to ``MOST_GRAMS`` grams; Spark joins more by shuffle, with the same result.
    Columns of the two names are replaced, others kept. An empty table gives no rows.
    """
    phrases, notices = PHRASES | VARIANTS if phrases is None else phrases, NOTICES if notices is None else notices
    made = ("license_words_", "license_spans_")
    docs = docs.drop(*made)
    name = spare(docs, "_name")
    named = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = template_grams(phrases, notices)
    t = docs.sparkSession.createDataFrame(rows, "_gram string, template string, label string, phrase string, size int, grams int, at int").withColumn("h", F.xxhash64("_gram"))
    t = F.broadcast(t) if len(rows) <= MOST_GRAMS else t
    begins = sorted({gram.split()[0] for gram, *_ in rows})
    w = docs.select(named.alias("doc"), words(F.col(text)).alias("w"))
    # The last grams of a text are shorter, and no gram of a template.
    gram = lambda i, k: lower_ascii(F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)]))
    pair = lambda x, i: F.when(F.lower(x).isin(begins), F.struct(i.alias("i"), F.array(gram(i, SHORT), gram(i, LONG)).alias("g")))
    pairs = w.select("doc", F.explode_outer(F.filter(F.transform("w", pair), lambda p: p.isNotNull())).alias("p"))
    grams = pairs.select("doc", "p.i", F.explode_outer("p.g").alias("gram")).withColumn("h", F.xxhash64("gram"))
    hits = grams.join(t, "h").where(F.col("gram") == F.col("_gram"))
    by = ["doc", "template", "label", "phrase", "size", "grams"]
    lines = hits.groupBy(*by, (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    order = Window.partitionBy("doc", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("phrase").isNull(), slack).otherwise(0)
    lines = lines.withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(order))
    found = lines.groupBy(*by, "run").agg(
        F.min(F.array_min("at") + F.col("diagonal")).alias("start"), (F.max(F.array_max("at") + F.col("diagonal")) + F.col("size")).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"),
    )
    score, most = F.col("found") / F.col("grams"), 1.5 * (F.col("grams") + F.col("size") - 1)
    sure = found.where((score >= F.when(F.col("phrase").isNull(), least).otherwise(1.0)) & (F.col("end") - F.col("start") <= most))
    span = F.struct("start", "end", "label", "phrase", score.alias("score"))
    spans = sure.groupBy(F.col("doc").alias(name)).agg(F.array_sort(F.collect_list(span).cast(_SPAN)).alias(made[1]))
    out = docs.withColumn(name, named).withColumn(made[0], F.size(words(F.col(text))).cast("long")).join(spans, name, "left")
    return out.select(*[F.col(c) for c in docs.columns], made[0], F.coalesce(made[1], F.array().cast(_SPAN)).alias(made[1]))


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    out = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("license_spans_")
    base = F.filter(spans, lambda s: s["phrase"].isin(*PHRASES))
    first = F.transform(base, lambda s: s["start"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")
    return out.select(
        "doc_id", F.col("license_words_").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"), labels(spans).alias("labels"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    grams = ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in template_grams(PHRASES | VARIANTS, NOTICES))
    base = ", ".join(map(quote, PHRASES))
    return rf"""
WITH t(gram, template, label, phrase, size, grams, pos) AS (VALUES {grams}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {SHORT}], ' ') AS gram, {SHORT} AS size FROM g WHERE i + {SHORT} <= len(w)
      UNION ALL SELECT doc_id, i, array_to_string(w[i + 1:i + {LONG}], ' '), {LONG} FROM g WHERE i + {LONG} <= len(w)),
h AS (SELECT DISTINCT doc_id, template, label, phrase, size, grams, pos, i - pos AS diagonal FROM k JOIN t USING (gram, size)),
d AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN any_value(phrase) IS NULL THEN 8 ELSE 0 END THEN 1 ELSE 0 END AS far
      FROM h GROUP BY doc_id, template, diagonal),
r AS (SELECT doc_id, template, diagonal, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM d),
f AS (SELECT doc_id, label, phrase, grams, size, min(pos + diagonal) AS start, max(pos + diagonal) + size AS finish, count(DISTINCT pos) AS found
      FROM h JOIN r USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, phrase, grams, size, run),
s AS (SELECT *, CAST(found AS DOUBLE) / grams AS score FROM f
      WHERE CAST(found AS DOUBLE) / grams >= CASE WHEN phrase IS NULL THEN 0.6e0 ELSE 1 END AND finish - start <= 1.5e0 * (grams + size - 1)),
b AS (SELECT doc_id, count(*) FILTER (WHERE phrase IN ({base})) AS n_base, min(start) FILTER (WHERE phrase IN ({base})) AS first_word, max(start) FILTER (WHERE phrase IN ({base})) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase IN ({base})) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN b USING (doc_id)
"""


OP12_SQL = _sql()
