"""The stored index: phrases, generations, repair and schema versions."""

import math

import pytest
from pyspark.sql import functions as F

from larder.operators import index, search

CHUNK = "doc_id long, ordinal int, text string, heading string"
ROWS = [(1, 0, "the quick brown fox", "Fox tales"), (1, 1, "the slow fox", None), (2, 0, "检索增强生成 model", None), (3, 0, "quick the", "brown"), (4, 0, None, None), (5, 0, "索增 检", "检索"), (6, 0, "Straße ſchnell ὈΔΥΣΣΕΎΣ", None)]
ASKED = [(1, "quick fox"), (2, "检索"), (3, "检索增强"), (4, "!!"), (5, "fox fox"), (6, "强生成"), (7, "schnell"), (8, "οδυσσευσ")]


def frame(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def asked(spark, rows=ASKED):
    return spark.createDataFrame(rows, "query_id int, text string")


def hits(df):
    return {(r["query_id"], r["doc_id"], r["ordinal"]): r["score"] for r in df.collect()}


def expected(rows, queries):
    """BM25 by hand over the three fields of each chunk."""
    import unicodedata

    def words(text):
        low = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower().replace("ς", "σ").replace("ſ", "s")) if not unicodedata.combining(c))
        return "".join(c if c.isalnum() else " " for c in low).split()

    def pairs(text):
        out, run = [], ""
        for c in [*(text or ""), None]:
            if c and "一" <= c <= "鿿":
                run += c
                continue
            out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
            run = ""
            out.append(c or "")
        text = ""
        for x in out:
            text += f" {x} " if x and "一" <= x[0] <= "鿿" else x
        return words(text)

    fields = {(d, o): (words(t), words(h), pairs(t)) for d, o, t, h in rows}
    n, avg = len(fields), sum(len(f) for fs in fields.values() for f in fs) / len(fields)
    got = {}
    for query, text in queries:
        for token in "".join(c if c.isalnum() else " " for c in text).split():
            terms = pairs(token)
            tf = {k: sum(f[i : i + len(terms)] == terms for f in fs for i in range(len(f))) for k, fs in fields.items()}
            df = sum(v > 0 for v in tf.values())
            idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
            for k, v in tf.items():
                if v:
                    size = sum(map(len, fields[k]))
                    got[(query, *k)] = got.get((query, *k), 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * size / avg))
    return {k: round(v, 6) for k, v in got.items()}


def test_phrases_of_several_terms(spark, tmp_path):
    index.build(frame(spark, ROWS), f"{tmp_path}/i", buckets=3)
    got = hits(index.search(spark, f"{tmp_path}/i", asked(spark)))
    assert got == pytest.approx(expected(ROWS, ASKED), abs=2e-6)
    assert {k[1] for k in got if k[0] == 3} == {2} and not [k for k in got if k[0] == 4]
    assert hits(search.bm25(frame(spark, ROWS), asked(spark))) == got


def test_search_reads_only_the_index(spark, tmp_path):
    root = f"{tmp_path}/i"
    index.build(frame(spark, ROWS), root)
    plan = index.search(spark, root, asked(spark, [(1, "fox")]))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan.split("FileScan")[1] and "In(term, [fox])" in plan or "EqualTo(term,fox)" in plan


def test_reindex_touches_only_its_items(spark, tmp_path):
    root = f"{tmp_path}/i"
    index.build(frame(spark, ROWS), root)
    new = [r for r in ROWS if r[0] not in (1, 5)] + [(1, 0, "a new quick fox", None), (7, 0, "fox", None)]
    touched = spark.createDataFrame([(1,), (5,), (7,)], "doc_id long")
    index.reindex(frame(spark, new), touched, root)
    got = index.search(spark, root, asked(spark))
    assert hits(got) == pytest.approx(expected(new, ASKED), abs=2e-6)
    last = spark.read.parquet(f"{root}/postings").where("gen = 1")
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {1, 7}
    index.reindex(frame(spark, ROWS), touched, root)
    assert hits(index.search(spark, root, asked(spark))) == pytest.approx(expected(ROWS, ASKED), abs=2e-6)
    index.build(frame(spark, new), root)
    assert hits(index.search(spark, root, asked(spark))) == pytest.approx(expected(new, ASKED), abs=2e-6)


def test_a_lost_job_is_not_read(spark, tmp_path):
    root = f"{tmp_path}/i"
    index.build(frame(spark, ROWS), root)
    before = hits(index.search(spark, root, asked(spark)))
    half = index.postings(frame(spark, [(9, 0, "fox", None)])).withColumn("bucket", F.lit(0))
    index._write(half, root, "postings", 1, ("bucket",))  # written, and not committed
    assert hits(index.search(spark, root, asked(spark))) == before
    index.reindex(frame(spark, [(9, 0, "quick", None)]), spark.createDataFrame([(9,)], "doc_id long"), root)
    got = hits(index.search(spark, root, asked(spark)))
    assert (1, 9, 0) in got and (5, 9, 0) not in got


def test_repair_rebuilds_first(spark, tmp_path):
    root, touched = f"{tmp_path}/i", spark.createDataFrame([(1,)], "doc_id long")
    assert not index.available(spark, root)
    assert index.repair(frame(spark, ROWS), touched, root) == "rebuilt" and index.available(spark, root)
    assert index.repair(frame(spark, ROWS), touched, root) == "reindexed"
    assert hits(index.search(spark, root, asked(spark))) == pytest.approx(expected(ROWS, ASKED), abs=2e-6)


def test_empty_table(spark, tmp_path):
    root = f"{tmp_path}/i"
    index.build(frame(spark, []), root)
    assert index.search(spark, root, asked(spark)).count() == 0


def test_schema_versions_read_alike(spark, tmp_path):
    old, new = frame(spark, ROWS[:3]), frame(spark, ROWS[3:]).withColumn("pairs", F.lit(None).cast("string"))
    old.write.parquet(f"{tmp_path}/v1")
    new.write.parquet(f"{tmp_path}/v2")
    both = index.read_chunks(spark, {1: f"{tmp_path}/v1", 2: f"{tmp_path}/v2"})
    index.build(both, f"{tmp_path}/i")
    assert hits(index.search(spark, f"{tmp_path}/i", asked(spark))) == pytest.approx(expected(ROWS, ASKED), abs=2e-6)
    with pytest.raises(ValueError):
        index.read_chunks(spark, {3: f"{tmp_path}/v1"})
