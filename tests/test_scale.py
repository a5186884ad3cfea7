"""Steps that have to grow no faster than their input: what they no longer do, and that their results stand."""

import random

from pyspark.sql import functions as F

from larder.functions.text import cjk_bigrams


def test_bigrams_in_one_pass(spark):
    """The pairs of odd texts by a plain walk; no list of runs is made."""

    def plain(text):
        runs = []
        for c in text:
            cjk = "一" <= c <= "鿿"
            if runs and runs[-1][0] == cjk:
                runs[-1][1] += c
            else:
                runs.append([cjk, c])
        parts = [" ".join(t[i : i + 2] for i in range(max(1, len(t) - 1))) if cjk else t.strip(" \t\n　") for cjk, t in runs]
        return " ".join(p for p in parts if p)

    random.seed(7)
    texts = ["".join(random.choice("检索增强a b\n\t　é😀x$\\1") for _ in range(random.randint(0, 14))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", cjk_bigrams(F.col("text")).alias("b"))
    assert {r["text"]: r["b"] for r in got.collect()} == {t: plain(t) for t in texts}
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_index_shuffles_no_tokens(spark, tmp_path):
    """A build deals no rows of tokens out and sorts none; postings of a term in a chunk are one row."""
    from larder.operators import index

    rows = [(1, 0, "a b a ab", None), (2, 0, "检索检 b", "a")]
    chunks = spark.createDataFrame(rows, "doc_id long, ordinal int, text string, heading string")
    plan = index._packed(chunks, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {(r["doc_id"], r["term"], r["field"]): (r["places"], r["times"], r["len"]) for r in index.postings(chunks).collect()}
    assert got[1, "a", 0] == ([0, 2], 2, 8) and got[2, "a", 1] == ([0], 1, 6) and got[2, "索检", 2] == ([1], 1, 6)
    assert len(got) == 3 + 6 + 2  # and a row without term for each chunk
    index.build(chunks, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/postings").count() == 9 and not spark.read.schema(index.PACKED).parquet(f"{tmp_path}/i/packed").count()


def test_index_texts_go_whole(spark, tmp_path):
    """A build sends a text with blanks between its tokens, not a list of them, and the words of it are those of ``tokens``; the items of a build come from its lengths, not from the texts."""
    from larder.functions.text import spaced, tokens, unmarked
    from larder.operators import index

    random.seed(5)
    parts = ["a", "Bc", "é", "ÀÅ", "Å", "İ", "ẛ", "ſ", "ß", "ΑΣ", "ΣΑ", "΅", "9", "½", "検", "・", "가", "😀", "𝒳", "\ue000", "\u0301", "\x85", "\u2028", "\u3000", " ", "  ", "\t", "\n", "\x0b", "\x1c", ".", "--", "'", ""]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 16))) for _ in range(2000)]
    rows = spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(texts)], "doc_id long, ordinal int, text string, heading string")
    for r in rows.select(spaced(F.col("text")).alias("s"), tokens(F.col("text")).alias("t")).collect():
        assert [w for w in unmarked(r["s"]).encode().split()] == [w.encode() for w in r["t"]]
    sent = index._fields(rows)
    assert {sent.schema[c].dataType.simpleString() for c in "thp"} == {"string"}
    got = {}
    for r in index.postings(rows).where("field = 0 and term is not null").collect():
        got.setdefault(r["doc_id"], []).extend((p, r["term"]) for p in r["places"])
    want = {r["doc_id"]: list(enumerate(r["t"])) for r in rows.select("doc_id", tokens(F.col("text")).alias("t")).collect() if r["t"]}
    assert {k: sorted(v) for k, v in got.items()} == want
    index.build(rows, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/touched").select("doc_id").distinct().count() == 2000


def test_a_search_passes_over_pages(spark, tmp_path):
    """Pages of a bucket that cannot hold the term are not read."""
    from larder.operators import index

    rows = spark.range(6000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"), F.format_string("w%05d", "id").alias("text"), F.lit(None).cast("string").alias("heading"))
    index.build(rows, f"{tmp_path}/i", buckets=1)
    found = index._read(spark, f"{tmp_path}/i", "postings", index.POSTING).where("term = 'w00001'")._jdf.queryExecution()
    plan = found.executedPlan()
    assert found.toRdd().count() == 1
    assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 4000


def test_items_are_chosen_before_their_texts_are_cut(spark):
    """Index rows of some items: the join stands below the explode."""
    from larder.plans.shared import index_rows

    ok = spark.createDataFrame([(1,), (5,)], "doc_id long")
    got = index_rows(spark, "/root/testdata/sf0.001", ok)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Join LeftSemi")
    want = index_rows(spark, "/root/testdata/sf0.001").where("doc_id in (1, 5)")
    assert sorted(map(tuple, got.select("doc_id", "ordinal", "text").collect())) == sorted(map(tuple, want.select("doc_id", "ordinal", "text").collect()))


def test_embedding_holds_few_texts(spark):
    """However many texts a batch has, a task holds the tokens of a bounded number."""
    from larder.operators import embed

    class Counted(embed.WordHashes):
        def tokenize(self, texts):
            if len(texts) > embed.ROWS:
                raise RuntimeError("too many texts at once")
            return super().tokenize(texts)

    profile = embed.Profile(Counted.name, Counted.version, "m", 64, "0" * 64, 3, 1)
    d = spark.range(1000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    got = embed.segments(d, Counted, profile)
    assert got.where("error is null").count() == 2000


def test_frontier_deals_no_rows_by_platform(spark):
    """The place of the first known id goes to the rows; rows of a platform do not go to one task."""
    from larder.operators import ingest

    rows = spark.createDataFrame([("j", "x", 0, i, str(i)) for i in range(5)] + [("j", "zhihu", 0, 0, "3")], "job_id string, platform string, page int, pos int, source_id string")
    known = spark.createDataFrame([("j", "x", ["3", "4"])], "job_id string, platform string, ids array<string>")
    got = ingest.cut_at_frontier(rows, known, "with")
    assert sorted((r["platform"], r["pos"]) for r in got.collect()) == [("x", 0), ("x", 1), ("x", 2), ("x", 3), ("zhihu", 0)]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan


def test_cosine_keeps_the_best_of_a_task(spark):
    """A task gives out k rows a query, not k for each block; equal scores go to the smaller id, whether rows are held or given out early."""
    import numpy as np

    from larder.operators import search

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 0)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 4)], "doc_id long, v array<double>").coalesce(1)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "query_id int, q array<double>").coalesce(1)
    want = {(i, j, float(s)) for i in range(7) for j, s in sorted(enumerate(x @ x[i]), key=lambda t: (-t[1], t[0]))[:5]}
    for held in (1, 4_000_000):
        got = search.cosine(v, q, 5, rows=16, block=3, spread=1, held=held)
        assert {tuple(r) for r in got.collect()} == want
    from larder.operators.search import _best

    assert [a.tolist() for a in _best(np.array([1, 0, 1, 1]), np.array([4, 9, 2, 3]), np.array([0.5, 1, 0.5, 0.7]), 2)] == [[0, 1, 1], [9, 3, 2], [1, 0.7, 0.5]]


def test_cosine_gives_out_the_best_of_a_part_once(spark, monkeypatch):
    """With many blocks of queries a task still gives out k rows a query for a part, as it holds one block at a time."""
    from larder.operators import search

    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "doc_id long, v array<double>").coalesce(1)
    q = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)], "query_id int, q array<double>").coalesce(1)
    monkeypatch.setattr(search, "top", lambda scores, k: scores.withColumn("rank", search.F.lit(1)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        given = search.cosine(v, q, 5, rows=8, block=3, spread=1, held=20).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert given == 12 * 5


def test_widening_computes_its_arms_once(spark):
    """The pool of a query is found in windows over the candidates, which are read once."""
    from larder.operators import search

    arm = spark.range(7, 907).selectExpr("1 as query_id", "id as doc_id", "0 as ordinal", "cast(id - 6 as int) as rank")
    near = spark.createDataFrame([], "query_id int, doc_id long, ordinal int, rank int, score double")
    it = spark.range(1000).selectExpr("id as doc_id", "id as published", "'x' as platform", "cast(id as string) as source_id")
    told = spark.range(0, 1000, 60).selectExpr("id as doc_id", "1.0D as factor")
    wide = search.widen(arm, near, it, told, 5)
    assert {r["pool"] for r in wide.select("pool").collect()} == {400}  # 60, 120, 180, 240, 300
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Range (7, 907") == 1
    hits = search.group_hits(wide, told, 5)
    assert {(r["pool"], r["doc_id"]) for r in hits.collect()} == {(400, 60 * i) for i in range(1, 6)}


def test_answer_shuffles_no_text(spark):
    """The few hits go to the chunks, not all chunks with their texts to the hits."""
    import re

    from larder.plans import checks

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = checks._answer(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[doc_id#\d+L, ordinal#\d+\], \[doc_id#\d+L, ordinal#\d+\], Inner", plan)


def test_entries_of_a_page_are_read_once(spark):
    """Rule and result of a page share what was read of its entries: each value is asked for its type once or twice, and no page or entry for its whole schema."""
    from larder.sources import pages

    p = spark.createDataFrame([("{}",)], "body string")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        asked = {f.__name__: f(p)._jdf.queryExecution().optimizedPlan().toString().lower().count("schemaofvariant") for f in (pages.x_bookmarks, pages.bilibili_resources, pages.zhihu_items)}
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    most = {"x_bookmarks": 150, "bilibili_resources": 60, "zhihu_items": 100}
    assert all(asked[k] <= most[k] for k in most), asked


def test_explode_parses_no_page_again(spark):
    """No filter on a page's list of entries stands below its explode, where it would parse the page once more."""
    from larder.plans import capture, checks

    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        for make in (capture.x_items, capture.bilibili_items, capture.zhihu_items, checks.zhihu_answers):
            plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
            assert not [line for line in plan.splitlines() if "Filter (size(" in line.replace("((", "(")], make.__name__
            assert plan.lower().count("schemaofvariant") <= 150, make.__name__
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
