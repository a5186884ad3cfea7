"""Edge cases of every operator, and brute-force versions on small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402
from larder.llm import decontam, language, lines, lm, mixing, near_dup, pii, secrets, toxicity, vector_search  # noqa: E402

WORD = re.compile(r"[^ \t-\r]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [None, "", " \t\n ", "one", "x" * 5000 + " a@b.co 1.2.3.4", "token=ab secret: 'abcdef99' AKIA" + "A" * 16 + " " + "0f" * 12, "mail me at jo@ex.org or +1 (555) 010-9999, 4111 1111 1111 1111"]
    for i in range(30):
        base = text(60)
        words = base.split()
        rows += [base, base.upper()]
        if i % 3 == 0:
            words[7] = "zz"
            rows += [" ".join(words), "shared line\n" + base + "\n\nShared Line "]
    return [(i, t, [None, "en", "fr"][i % 3], ["s1", "s2", "s3", None][i % 4]) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    full = [(*r, "clash", "clash", "clash") for r in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n string, rep string, spans string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, docs[9][1]), (1, None), (2, "short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = random.Random(1)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(400, None), (500, [1.0] * 7 + [None]), (600, [float("nan")] * 8), (700, [0.5] * 8), (701, [0.5] * 8)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def by_id(frame):
    return {r.doc_id: r for r in frame.itertuples()}


def joined(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_pii_brute(spark, sf, docs):
    got = by_id(pii.op1_pii(spark, sf).toPandas())
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and pii._luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    for i, t, *_ in docs:
        want = [(m.start(), k, m.end()) for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m.group())]
        assert got[i].base_sha256 == joined(want)
    assert got[6].n_email == got[6].n_phone == got[6].n_card == 1


@pytest.mark.parametrize("most", [50_000, 0])  # 0: the terms are joined, not broadcast
def test_pii_terms(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MOST_TERMS", most)
    rows = [(i, f"Reach agent{'x' * (i % 2)} kontakt u{i}@ex.org filler words that go on and on {i % 7}") for i in range(60)]
    rows += [(i, "plain prose about gardens, weather and bread, with no address in it at all") for i in range(60, 400)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    got = got[got.doc_id < 60]
    assert len(got) == 60 and all("<email>" in t and "kontakt" not in t for t in got.clean_text)


@pytest.mark.parametrize("most", [50_000, 0])
def test_pii_terms_go_everywhere(spark, monkeypatch, most):
    """A revealing term goes from texts without a pattern and far from one; a name tied to one number in few texts reveals."""
    monkeypatch.setattr(pii, "MOST_TERMS", most)
    rows = [(i, f"kontakt u{i}@ex.org filler words that go on and on") for i in range(60)]
    rows += [(i, "Somebody saw Kontakt in a garden where no address was") for i in range(60, 70)]
    rows += [(i, f"Zorvath {n} wrote a letter from home again") for i, n in zip(range(70, 75), ["+1 555 010 9999", "+1 (555) 010-9999"] * 3)]
    rows += [(75, "nobody has met zorvath there"), (None, "it was zorvath"), (None, None)]
    rows += [(i, "plain prose about a garden, weather and bread, with no address in it at all") for i in range(80, 400)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows)
    clean = " ".join(got.clean_text).lower()
    assert "kontakt" not in clean and "zorvath" not in clean
    assert "somebody saw <term> in a garden where no address was" in clean and "nobody has met <term> there" in clean
    assert clean.count("plain prose about a garden, weather and bread") == 320


def test_secrets_brute(spark, sf, docs):
    got = by_id(secrets.op6_secret_scan(spark, sf).toPandas())
    assign = re.compile(secrets.RULES[0][2])
    for i, t, *_ in docs:
        t = t or ""
        want = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 6]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        assert got[i].base_sha256 == joined([(s, k, e) for s, _, k, e in sorted(want)])


def test_secret_ledger_is_incremental(spark, sf):
    """Seen pairs of blob and rule version are not scanned again; a new rule version is scanned alone; copies share a blob."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf}/documents.parquet")
    ledger = secrets.scan_blobs(d, "doc_id", "text")
    n = d.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert ledger.count() == 3 * n
    assert secrets.scan_blobs(d.union(d), "doc_id", "text", ledger).count() == 0
    newer = [(k, v + (k == "hex"), *r) for k, v, *r in secrets.RULES]
    fresh = secrets.scan_blobs(d, "doc_id", "text", ledger, newer)
    assert {(r.rule, r.version) for r in fresh.collect()} == {("hex", 2)} and fresh.count() == n
    marked = ledger.withColumn("spans", F.when(F.col("rule") == "hex", F.expr("array(named_struct('start', 7, 'rank', 2, 'kind', 'hex', 'end', 9))")).otherwise(F.col("spans")))
    got = secrets.findings(d.union(d), "doc_id", "text", marked).collect()  # what the ledger says, without a scan
    assert len(got) == 2 * d.count() and all(any((s.start, s.end) == (7, 9) for s in r.spans) for r in got)
    odd = secrets.findings(spark.createDataFrame([(None, "token=abcdefg"), (None, "token=abcdefg")], "doc_id long, text string"), "doc_id", "text", ledger).collect()
    assert len(odd) == 2 and all(r.spans == [] for r in odd)


def test_near_dups_brute(spark, sf, docs):
    got = by_id(near_dup.op7_minhash_dedup(spark, sf).toPandas())
    sets, label = {}, {}
    for i, t, *_ in docs:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
        label[i] = i
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i)


def test_near_dups_members_that_only_meet_others(spark):
    """A text close to one member of a large bucket, and not to its centre, still joins the group."""
    rng = random.Random(5)
    core = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(core)
        for _ in range(1 + i % 3):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    links = 0
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links += 1
                assert got[i] == got[j]
    assert links


def test_near_dups_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda p: " ".join(f"{p}{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, e, f = (text(p) for p in "abcef")
    near = " ".join([*b.split()[:-1], "other"])
    rows = [(None, a), (None, a), (5, a), (None, c), (None, c), (7, b), (7, b), (7, e), (8, near), (9, e + " more"), (None, f), (3, None), (None, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.minhash_dedup(spark, d, "").collect()
    want = [(5, a), (None, c), (7, b), (7, e), (None, f), (3, None), (None, None), (None, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    out = near_dup.near_dups(d, k=2).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(want)


def lm_brute(rows, train, strength=4.0):
    """(n_tokens, n_known, train tokens, base, score) of each text, by the recursion itself."""
    toks = [[*WORD.findall(low(t)), "\n"] for _, t in rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for q, t in zip(toks, train):
        if t:
            h = ["\t", *q]
            c1.update(h)
            c2.update(zip(h, h[1:]))
            c3.update(zip(h, h[1:], h[2:]))
    n, v = sum(c1.values()) - c1["\t"], len(set(c1) - {"\t"})
    uni = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    two = lambda s, w: (c2[s, w] + strength * uni(w)) / (c1[s] + strength) if c1[s] else uni(w)
    three = lambda r, s, w: (c3[r, s, w] + strength * two(s, w)) / (c2[r, s] + strength) if c2[r, s] else two(s, w)
    for q in toks:
        h = ["\t", *q]
        p = [two(h[0], h[1])] + [three(*h[i - 2 : i + 1]) for i in range(2, len(h))]
        yield len(q), sum(c1[w] > 0 for w in q), n, sum(math.log10(uni(w)) for w in q), sum(map(math.log10, p))


def test_lm_brute(spark, sf, docs):
    got = by_id(lm.op10_lm_score(spark, sf).toPandas())
    want = lm_brute([d[:2] for d in docs], [zlib.crc32(str(d[0]).encode()) % 10 for d in docs])
    for (i, *_), w in zip(docs, want, strict=True):
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert math.isclose(g.base_score, w[3], rel_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9)


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_lm_blocks_null_and_repeated_ids(spark, most):
    """Every block size gives the same scores; rows of one id, null ids and copies stay rows; a long text crosses blocks."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("a b c d e".split(), k=rng.randint(0, 12)))) for i in range(20)] + [(3, "a b"), (3, "a b"), (None, "c d e"), (None, None), (7, "a b c " * (400 if most > 2 else 9))]
    d = spark.createDataFrame([(*r, True, "clash") for r in rows], "doc_id long, text string, train boolean, row string")
    got = lm.lm_scores(d, F.when(F.col("doc_id").isNotNull(), F.col("doc_id") % 4 != 0), most=most).toPandas()
    want = list(lm_brute(rows, [i is not None and i % 4 != 0 for i, _ in rows]))
    key = lambda x: (x[0], x[1], x[2], round(x[3], 6), round(x[4], 6))
    assert sorted(map(key, got[["n_tokens", "n_known", "train_tokens", "base_score", "score"]].itertuples(index=False))) == sorted(map(key, want))
    assert got.doc_id.isna().sum() == 2 and (got.doc_id == 3).sum() == 3


def test_mix(spark, sf, docs):
    got = mixing.op8_source_mix(spark, sf).toPandas()
    again = mixing.op8_source_mix(spark, sf).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))
    got["source"] = [{i: s for i, _, _, s in docs}[i] for i in got.doc_id]
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    sums = got.groupby("source", dropna=False).agg(own=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert math.isclose(sums.target.sum(), 1.5 * got["size"].sum(), rel_tol=1e-9)
    assert ((sums.taken - sums.target).abs() <= 8).all() and (sums.target <= 2 * sums.own + 1e-6).all()


def test_sainte_lague_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    want = [rng.randint(1, 400) for _ in range(37)]
    cells = spark.createDataFrame([(0, i, float(w)) for i, w in enumerate(want)], "g int, i int, w double")
    for seats in (0, 1, 20, 777):
        got = mixing.sainte_lague(cells, ["g"], F.col("i"), F.col("w"), F.lit(seats)).toPandas().set_index("i").quota
        held = [0] * len(want)
        for _ in range(seats):
            j = max(range(len(want)), key=lambda x: (want[x] / (2 * held[x] + 1), -x))
            held[j] += 1
        assert [int(got[i]) for i in range(len(want))] == held


@pytest.mark.parametrize("name", ["op4_exact_top_k", "op9_line_dedup"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    a, b = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(b.columns)
    assert sorted(a[cols].astype(str).values.tolist()) == sorted(b[cols].astype(str).values.tolist())


def test_decontamination(spark, sf, docs):
    got = by_id(decontam.op5_decontamination(spark, sf).toPandas())
    item = low(docs[9][1]).split()
    # 7 and 8 differ from the item by one word, 9 is the item, 10 holds that text after another line.
    assert {i for i in got if got[i].contaminated} == {7, 8, 9, 10}
    hit = item[:10] + ["new"] + item[11:24] + ["other"] + item[25:]
    d = spark.createDataFrame([(1, "start here " + " ".join(hit))], "doc_id long, text string")
    assert decontam.decontaminate(d, spark.read.parquet(f"{sf}/benchmark.parquet")).first()["bench_items_"] == 1


def test_decontamination_short_items_and_first_word(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "what is the Capital of France"), (2, "xylophone"), (3, ""), (4, None)], "item_id long, text string")
    rows = ["some words " + " ".join([*item[:i], "other", *item[i + 1 :]]) + " and more" for i in range(10)]
    rows += ["quiz: what is the capital of france ?", "what is the capital of france what is the capital of france", "what is the capital of spain", "a xylophone and a Xylophone", "what is the", "capital of france", "", None]
    got = decontam.decontaminate(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), bench).orderBy("doc_id").collect()
    assert [r.bench_items_ for r in got] == [1] * 10 + [1, 1, 0, 1, 0, 0, 0, 0]
    assert [r.bench_overlap_ for r in got] == [9] * 10 + [6, 6, 0, 1, 0, 0, 0, 0]


def test_language_and_toxicity(spark, sf):
    got = by_id(language.op3_language_id(spark, sf).toPandas())
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and {r.lang_pred for r in got.values()} <= {"und", "en", "fr"}
    tox = toxicity.op2_toxicity(spark, sf).toPandas()
    assert len(tox) == len(got) and tox.score.between(0, 1).all() and ((tox.score >= 0.3) == (tox.predicted == 1)).all()


def test_language_sample_keeps_rare_languages_beside_copies(spark):
    """Many copies of the text of least hash, one rare language and a bound that the copies alone exceed."""
    from pyspark.sql import functions as F

    from larder.llm.common import per_class

    d = spark.createDataFrame([(f"the weather in the garden is number {i} of many", "en") for i in range(300)] + [(f"sää puutarhassa on tänään {i} hyvä", "fi") for i in range(3)], "text string, lang string")
    first = d.where("lang = 'en'").orderBy(F.xxhash64("text")).first().text
    d = d.union(spark.createDataFrame([(first, "en")] * 500 + [(first, None), (None, "en")], "text string, lang string"))
    model = language.fit(d, sample=20)
    assert set(model.langs) == {"en", "fi"}
    got = language.predict(spark.createDataFrame([("puutarhassa on hyvä sää",)], "text string"), model).first()
    assert got.lang_ == "fi"
    some = per_class(d, "text", "lang", 20).toPandas()
    assert Counter(some.lang) == {"en": 20, "fi": 3} and not some.duplicated(["text", "lang"]).any()


def test_toxicity_kernel_brute():
    """Every pair of three letters within SPAN, weights summed per subsequence; 1 for equal words, above 0 for gapped ones."""
    from itertools import combinations

    def vector(w):
        v = Counter()
        for i in combinations(range(len(w)), 3):
            if i[2] - i[0] < toxicity.SPAN:
                v["".join(w[j] for j in i)] += toxicity.DECAY ** (i[2] - i[0] - 2)
        return v

    def cosine(a, b):
        return sum(a[k] * b[k] for k in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    names = ["idiot", "garden", "iidiiott"]
    marks = toxicity.Landmarks([n.encode() for n in names])
    words = ["idiot", "iidiiott", "idxiot", "idxxiot", "ixdxixoxt", "garden", "gardener", "window", "abcdefghijklmnop"]
    got = marks.kernel([w.encode() for w in words])
    for w, row in zip(words, got):
        for n, k in zip(names, row):
            assert math.isclose(k, cosine(vector(w), vector(n)) ** toxicity.DEGREE, abs_tol=1e-5)
    assert math.isclose(float(got[0][0]), 1, abs_tol=1e-5) and got[2][0] > 0.2 and got[3][0] > 0.02 and got[4][0] > 0 and got[8][0] == 0


def test_toxicity_pieces():
    for t in ("you i d i o t !", "you i.d.i.o.t", "You I-D-I-O-T", "you I  D I O T", "you 1idiot2"):
        assert b"idiot" in toxicity.pieces(t), t
    assert toxicity.pieces(None) == toxicity.pieces(" . 1 a b ") == set()
    assert toxicity.pieces("a cat") == {b"cat"}


def test_toxicity_learns(spark):
    """Insults are flagged as they are, spaced and dotted, in long texts too; clean texts are not; null and repeated ids are rows."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    vocab = ["".join(rng.choices("aeiourstnlmk", k=rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(i, f"{text(30)} you {['idiot', 'scum', 'clown'][i % 3]} {text(30)}" if i % 2 else text(60)) for i in range(300)]
    d = spark.createDataFrame([*rows, rows[1], (None, "idiot"), (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i, _ in rows), (None, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    asked = [text(50) + " idiot " + text(50), "you i d i o t", "you s.c.u.m", text(40) + " clown " + text(30), text(50), text(3000), "", None]
    a = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").withColumn("toxicity_", F.lit("clash"))
    got = [r.toxicity_ for r in toxicity.score(a, model).orderBy("doc_id").collect()]
    assert [x >= 0.3 for x in got[:3] + got[4:]] == [True] * 3 + [False] * 4 and got[3] > 2 * max(got[4:]), got
    assert toxicity.fit(d, labels.where("toxic = 0")).scores(["x"]).tolist() == [0.0]


# op13 reads another table; tests/llm/test_round3.py has its odd rows and empty table.
@pytest.mark.parametrize("op", sorted(k for k in entry.queries() if k.startswith("op") and not k.startswith("op13_")))
def test_empty_table(spark, sf, op, tmp_path):
    for t in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert entry.queries()[op](spark, str(tmp_path)).count() == 0


NAMES = ["row", "_row", "_doc", "doc", "_g", "key", "_key", "label", "n", "set", "lines", "kept", "drops", "h", "lang_", "n_lines_", "n_dropped_", "bench_items_", "toxicity_", "_id", "_text", "blob", "spans", "size", "taken", "block", "t"]


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    """Null and repeated ids, repeated rows, a text of 200 000 characters, ties, nulls in every column, and columns named like helpers."""
    d = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"word{i % 3000}x" for i in range(22_000))
    item = docs[9][1]
    rows = [(None, None, None, None), (None, item, "en", None), (None, item, "en", None), (1, long, "en", "s"), (1, long, "en", "s"), (2, long + " end", "fr", "s"), (3, "", "fr", None), (3, "un autre texte avec des mots", "fr", "t"), (4, "plain words in a line\n" * 30, "en", "t"), (5, "q\u0001 \ud7ff 😀 \t", None, "t")]
    cols = ", ".join(f"{c} string" for c in NAMES)
    spark.createDataFrame([(*r, *NAMES) for r in rows], f"doc_id long, text string, lang string, source string, {cols}").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (None, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (9, []), (11, [1.0, None])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("op", sorted(k for k in entry.queries() if k.startswith("op") and k != "op4_exact_top_k" and not k.startswith("op13_")))
def test_odd_rows(spark, odd, op):
    """One row out for each row in, null and repeated ids included."""
    got = [r.doc_id for r in entry.queries()[op](spark, odd).collect()]
    assert sorted(got, key=str) == sorted([None, None, None, 1, 1, 2, 3, 3, 4, 5], key=str)


def test_odd_vectors(spark, odd):
    got = sorted(map(tuple, vector_search.op4_exact_top_k(spark, odd).collect()))
    k = 1024 * 1024 * 5
    assert got == [(0, 1, 100, k), (0, 1, 100, k), (100, 1, 0, k), (100, 2, 0, k)]


def test_odd_pipeline_keeps_columns(spark, odd):
    """Every stage keeps the caller's columns and their values, whatever their names, and clean rows with null ids."""
    import corpus_pipeline

    d = spark.read.parquet(f"{odd}/documents.parquet")
    want = {"language_id": 8, "line_dedup": 10, "minhash_dedup": 7, "decontamination": 8, "source_mix": 10}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, d, odd).collect()
        if name in ("line_dedup", "source_mix", "decontamination"):
            assert len(rows) == want[name], name
        assert sum(r.doc_id is None for r in rows) >= 1 or name == "language_id"
        if name != "source_mix":
            assert all([r[c] for c in NAMES] == NAMES for r in rows), name


def test_dedup_lines_keeps_clashing_columns(spark):
    d = spark.createDataFrame([(i, "same\nown %d" % i, "a", "b", "c") for i in range(10)] + [(None, "same\nx", "a", "b", "c")], "doc_id long, text string, _lines string, row string, drops string")
    got = lines.dedup_lines(d).collect()
    assert len(got) == 11 and all((r._lines, r.row, r.drops, r.n_dropped_) == ("a", "b", "c", 1) and "same" not in r.text for r in got)


def test_decontamination_overlap_brute():
    """The best run of a diagonal equals the best over all its stretches."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        doc, item = rng.integers(0, 3, rng.integers(0, 14)), rng.integers(0, 3, rng.integers(1, 10))
        diag = int(rng.integers(-10, 14))
        lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
        same = [bool(item[i] == doc[i + diag]) for i in range(lo, hi)]
        runs = [(sum(1 if s else -4 for s in same[a:b]), sum(same[a:b])) for a in range(len(same)) for b in range(a + 1, len(same) + 1)]
        best = max([s for s, _ in runs], default=0)
        run, whole = decontam.overlap(doc, item, diag)
        assert whole == sum(same) and (run == 0 if best <= 0 else (best, run) in runs)


def test_decontamination_brute(spark):
    """Items planted whole, with substitutions, cut short or not at all, against the rule on every diagonal."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    bench = [" ".join(rng.choices(vocab, k=rng.choice([6, 12, 20, 30]))) for _ in range(6)]
    rows = []
    for i in range(40):
        item = rng.choice(bench).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            item[rng.randrange(len(item))] = "new"
        item = item[: rng.choice([len(item), len(item), len(item) // 2])]
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(0, 15)) + item + rng.choices(vocab, k=5))))
    got = {r.doc_id: r.bench_items_ for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()}
    for i, t in rows:
        doc = t.split()
        n = 0
        for b in bench:
            item, hit = b.split(), False
            for d in range(-len(item) + 1, len(doc)):
                same = [d + j >= 0 and d + j < len(doc) and doc[d + j] == item[j] for j in range(len(item))]
                seed = any(all(same[p + j] for j, bit in enumerate(m) if bit == "1") and d + p >= 0 and d + p + 10 <= len(doc) for m in decontam.MASKS for p in range(len(item) - 9)) if len(item) >= 10 else all(same)
                runs = [(sum(1 if s else -4 for s in same[x:y]), sum(same[x:y])) for x in range(len(item)) for y in range(x + 1, len(item) + 1)] if seed else [(0, 0)]
                most = max(runs)[0]
                best = max(n for total, n in runs if total == most)
                score = best if 0.9 * len(item) > 12 else max(best, sum(same))
                hit |= bool(seed) and score >= min(12, 0.9 * len(item))
            n += hit
        assert got[i] == n, (i, t)


def test_language_grams_count_once():
    import numpy as np

    text = "abcdefghij klmno " * 12_000  # over three slices
    c = " ".join(text.split()) + " "
    assert language.counts(text).sum() == 3 * len(c) - 3 and np.array_equal(language.counts(text[:1000]), language.counts(text[:1000]))


@pytest.mark.parametrize("k", [2, 5])
def test_near_dups_recall(spark, k):
    """No link of brute force over a whole table is lost, and none is made up."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in near_dup.near_dups(d, k=k).collect()}
    sets, label = {}, {}
    for r in d.collect():
        w = WORD.findall(low(r.text))
        sets[r.doc_id] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        label[r.doc_id] = r.doc_id
    moved = True
    while moved:
        moved = False
        for i in sets:
            for j in sets:
                if i < j and label[i] != label[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    assert got == label


def test_pipeline(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        if name != "source_mix":
            assert out.columns == d.columns
    got = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    # Brute force of the stages that decide which rows stay, after the languages the model itself recognises.
    kept = corpus_pipeline.language_id(spark, d, sf)
    d1 = corpus_pipeline.line_dedup(spark, kept, sf).collect()
    common = {k for k, n in Counter(k for r in kept.collect() for k in {low(x.strip(" \t\n\x0b\x0c\r")) for x in (r.text or "").split("\n")} if k).items() if n >= 10}
    for r, raw in zip(sorted(d1), sorted(kept.collect())):
        assert r.text == "\n".join(x for x in (raw.text or "").split("\n") if low(x.strip(" \t\n\x0b\x0c\r")) not in common)
    sets = {r.doc_id: (lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))(WORD.findall(low(r.text))) for r in d1}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in sets):
            break
    bench = [low(r.text).split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    held = lambda t: any(sum(w[a + j] == b[j] for j in range(len(b)) if a + j < len(w)) >= min(12, 0.9 * len(b)) for w in [low(t).split()] for b in bench for a in range(max(1, len(w) - len(b) + 1)))
    want = {r.doc_id for r in d1 if label[r.doc_id] == r.doc_id and not held(r.text)}
    assert {r["doc_id"] for r in got} == want
    assert sum(r["taken"] for r in got) > 0 and all(r["taken"] <= 2 * r["size"] for r in got)
