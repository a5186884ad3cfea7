"""Fill in the middle, license scan and conversation repair."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
from larder.llm import fim, licenses, repair  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


def write(spark, path, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


# --- op11


ODD = [(1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, "a"), (6, "a\nb"), (7, "a\nb\n"), (8, "x<P>y\nz"), (9, "é\nü\n\n😀"), (10, "l\n" * 5000 + "end"), (None, "a\nb\nc"), (11, "< P>\n<S\n>M>\n"), (7, "a\nb\n"), (12, "\r\n\x00\n")]


def fim_expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_fim_of_odd_texts(spark, tmp_path):
    path = write(spark, tmp_path, "documents", ODD, "doc_id long, text string")
    got = sorted((tuple(r) for r in fim.op11_fill_in_middle(spark, path).collect()), key=repr)
    assert got == sorted((fim_expected(*r) for r in ODD), key=repr)


def test_fim_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "r", "h", "c")], "doc_id long, text string, _raw string, _hash string, _cut string")
    out = fim.fill_in_middle(docs).first()
    assert (out["_raw"], out["_hash"], out["_cut"]) == ("r", "h", "c")
    assert fim.fill_in_middle(fim.fill_in_middle(docs)).first() == out  # its own columns are replaced
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs, rate=0).first()["fim_form_"] == "plain"


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
def test_boundaries_against_a_scan(size):
    rng = random.Random(size)
    text = bytes(rng.choice(b"ab\n") for _ in range(size))
    units = re.findall(rb"[^\n]*\n|[^\n]+", text)
    b = fim.Boundaries(text)
    ends = list(itertools.accumulate(map(len, units), initial=0))
    assert len(b) == len(units)
    assert [b.select(i) for i in range(len(units) + 1)] == ends
    assert all(b.rank(at) == sum(0 < e <= at for e in ends) for at in range(size + 1))


# --- op12


def test_licenses_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert rows(licenses.op12_license_scan(spark, SF).toPandas()) == rows(con.sql(licenses.OP12_SQL).df())


def test_license_phrases_against_a_scan(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "mit", "x", "lİcense", "K", "nc"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ", ", "_"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", " ", "MIT", "MIT License", "cc by " * 3000]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (3, "mit license")]
    path = write(spark, tmp_path, "documents", data, "doc_id long, text string")
    expected = []
    for doc_id, text in data:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in hits]
        expected.append((doc_id, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))))
    got = licenses.op12_license_scan(spark, path).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_changed_notices(spark):
    notice = next(iter(licenses.NOTICES)).split()
    changed = notice[:15] + ["well", "then"] + notice[15:40] + notice[44:]
    half = notice[:20]
    texts = [" ".join(["x"] * 9 + changed + ["y"]), " ".join(half), " ".join(notice + notice), " ".join(reversed(notice))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["license_spans_"] for r in licenses.find_licenses(docs).collect()}
    assert [(s["start"], s["end"], s["label"]) for s in got[0]] == [(9, 9 + len(changed), "mit")] and 0.6 <= got[0][0]["score"] < 1
    assert got[1] == [] and got[3] == []
    assert [(s["start"], s["end"], s["score"]) for s in got[2]] == [(0, len(notice), 1.0), (len(notice), 2 * len(notice), 1.0)]


def test_license_templates_by_shuffle_and_odd_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "mit license", "a", "b")], "doc_id int, text string, _name string, w string")
    one = licenses.find_licenses(docs).collect()
    assert (one[0]["_name"], one[0]["w"], one[0]["license_words_"]) == ("a", "b", 2)
    monkeypatch.setattr(licenses, "MOST_GRAMS", 0)
    assert licenses.find_licenses(docs).collect() == one
    assert licenses.find_licenses(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.find_licenses(docs, phrases={"mit": "mit"})


# --- op13


def cheapest(turns):
    """(cost, audit, repaired lines) of (role, text, must go, truncated) by trying all edits."""
    best = 2 * len(turns), "D" * len(turns), []

    def go(i, out, cost, audit):
        nonlocal best
        initials = "".join(r[:1] for r, _ in out)
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(turns):
            if re.fullmatch("(s?(ua)+)?", initials) and (cost, audit) < best[:2]:
                best = cost, audit, [f"{r}:{t}" for r, t in out]
        if len(out) <= len(turns) + 1 and audit[-3:] != "III":
            for role in ("user", "assistant"):
                go(i, [*out, (role, "")], cost + 5, audit + "I")
        if i < len(turns):
            role, text, gone, cut_off = turns[i]
            go(i + 1, out, cost + 2, audit + "D")
            if not gone:
                go(i + 1, [*out, (role, text)], cost + 5 * cut_off, audit + "K")
                for other in ("user", "assistant"):
                    go(i + 1, [*out, (other, text)], cost + 5 * cut_off + 1, audit + "R")

    go(0, [], 0, "")
    return best


def repair_expected(conversations, edits=True):
    """The contract, row by row; without ``edits`` the columns before them."""
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, given in groups.items():
        kept = []
        for turn, role, text in given:
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            role = "user" if fault == 4 else role
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, *_ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest(turns) if edits else (0, "", [])
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, count, most):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c?", "d", "", " ", None, "e.", "f"]
    out = []
    for conv in range(count):
        for turn in range(rng.randint(1, most)):
            out.append((conv, rng.choice([turn, turn, turn, turn * 3, 1, None]), rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]), rng.choice(texts)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_all_edits(spark, tmp_path, seed):
    data = conversations(seed, 100, 5) + [(None, 0, "user", "x."), (None, 1, None, None), (777, 1, "user", "same."), (777, 1, "user", "same."), (777, 2, "assistant", "y")]
    path = write(spark, tmp_path, "conversations", data, SCHEMA)
    got = sorted((tuple(r) for r in repair.op13_conversation_repair(spark, path).collect()), key=repr)
    assert got == repair_expected(data)


def test_blocks_change_nothing(spark):
    data = [(c, t, r, x, 1) for c, t, r, x in conversations(3, 60, 9)]
    turns = spark.createDataFrame(data, "conv long, turn long, role string, text string, n int")
    results = []
    for block in (1, 2, 4096):
        report, repaired = repair.repair(turns, block=block)
        lines = {}
        for r in repaired.collect():
            lines.setdefault(r["conv"], []).append(((r["block"] is not None, r["block"]), r["place"], r["role"], r["text"]))
        results.append((sorted(map(tuple, report.collect())), {c: [x[2:] for x in sorted(v, key=lambda x: (x[0][0], x[0][1] or 0, x[1]))] for c, v in lines.items()}))
    assert results[0] == results[1] == results[2]


def test_long_conversation_and_many_copies(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t {t}.", 1) for t in range(20_000)] + [(2, 0, "user", "same.", 50_000), (3, 0, "user", "gone.", 0)]
    report, repaired = repair.repair(spark.createDataFrame(turns, "conv long, turn long, role string, text string, n long"))
    got = {r["conv"]: r for r in report.collect()}
    assert got[1]["audit"] == "K" * 20_000 and got[1]["cost"] == 0
    assert got[2]["audit"] == "D" * 50_000 and got[2]["duplicate"] == 49_999
    assert (got[3]["audit"], got[3]["cost"], got[3]["gaps"]) == ("", 0, 0)
    assert repaired.where("conv = 1").count() == 20_000


def test_codes_are_free_of_prefixes():
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


def test_repair_base_columns(spark):
    """The columns before the edits, on a given table."""
    con = duckdb.connect()
    got = repair.op13_conversation_repair(spark, SF).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal").toPandas()
    data = [tuple(r) for r in con.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"]
    expected = [tuple(v for _, v in sorted(zip(names, r))) for r in repair_expected(data, edits=False)]
    assert rows(got) == sorted(expected, key=repr)


def test_repair_of_an_empty_table(spark, tmp_path):
    path = write(spark, tmp_path, "conversations", [], SCHEMA)
    assert repair.op13_conversation_repair(spark, path).count() == 0


def test_new_operators_read_extra_columns(spark, tmp_path):
    data = [(1, 0, "user", "a.", "x", 5), (1, 1, "assistant", "b.", None, 6)]
    path = write(spark, tmp_path, "conversations", data, SCHEMA + ", conv string, block int")
    assert repair.op13_conversation_repair(spark, path).first()["audit"] is not None
    turns = spark.createDataFrame([(1, 0, "user", "a.", 1, 2)], "conv long, turn long, role string, text string, n int, said int")
    assert repair.repair(turns)[0].where(F.col("cost") >= 0).count() == 1


def test_operators_run_where_workers_have_no_package(tmp_path):
    """The driver alone can import the package, as on a cluster that has no copy of it."""
    import os
    import subprocess

    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.range(1).count()
sys.path.append({str(ROOT)!r})
from larder.llm import queries
for name, query in queries.QUERIES.items():
    assert query(spark, {SF!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]


# --- op2, op3 and op5 against plain versions of the whole query


def test_toxicity_query_against_plain_kernels(spark, tmp_path):
    """Scores of the query from its model's landmarks and weights, with every subsequence listed one by one."""
    import math
    from collections import Counter

    from larder.llm import toxicity
    from larder.llm.common import fold

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeiourstnlmk", k=rng.randint(3, 7))) for _ in range(120)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    data = [(i, f"{text(6)} {['idiot', 'scum', 'clown'][i % 3]} {text(4)}" if i % 2 else text(10)) for i in range(200)] + [(200, None), (201, ""), (202, "you i d i o t"), (203, "a b"), (None, text(5))]
    path = write(spark, tmp_path, "documents", data, "doc_id long, text string")
    write(spark, tmp_path, "labels", [(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs.where(~held), labels.where(~held).select("doc_id", "toxic"))

    def vector(word):
        v = Counter()
        for i in itertools.combinations(range(len(word)), 3):
            if i[2] - i[0] < toxicity.SPAN:
                v[bytes(word[j] for j in i)] += toxicity.DECAY ** (i[2] - i[0] - 2)
        return v

    def cosine(a, b):
        return sum(a[k] * b[k] for k in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    marks = [vector(n) for n in model.landmarks.names]
    expected = {}
    for doc_id, t in data:
        words = [vector(w) for w in toxicity.pieces(t)]
        pooled = [max((cosine(w, m) for w in words), default=0.0) ** toxicity.DEGREE for m in marks]
        mapped = [sum(p * model.landmarks.map[i][j] for i, p in enumerate(pooled)) for j in range(len(marks))] + [1.0]
        margin = sum(a * b for a, b in zip(mapped, model.weights))
        expected[doc_id] = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
    got = toxicity.op2_toxicity(spark, path).collect()
    assert len(got) == len(data)
    for r in got:
        assert math.isclose(r["score"], expected[r["doc_id"]], abs_tol=1e-4) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)


def test_language_query_against_plain_vectors(spark, tmp_path):
    """Predictions of the query from its model's centroids, with n-grams, document frequencies and cosines counted one by one."""
    import math
    from collections import Counter

    from larder.llm import language

    rng = random.Random(9)
    words = {"en": "the of and to in that is was for with".split(), "fr": "le de un être et à il avoir ne je".split(), "de": "der die und in den von zu das mit sich".split()}
    data = [(i, " ".join(rng.choices(words[x], k=rng.randint(3, 30))), x) for i, x in enumerate(rng.choices(sorted(words), k=240))]
    data += [(240, None, "en"), (241, "", None), (242, "123 !?", "fr"), (243, "検索 検索", None), (None, "the of and", None)]
    path = write(spark, tmp_path, "documents", data, "doc_id long, text string, lang string")

    def grams(text):
        letters = [ord(c) if "a" <= c <= "z" or ord(c) >= 192 else 32 for c in (text or "").lower()]
        letters = [c for i, c in enumerate(letters) if c != 32 or i == 0 or letters[i - 1] != 32]
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(letters) - n + 1):
                h = 0
                for k, c in enumerate(letters[i : i + n], 1):
                    h = (h * 0x100000001B3 + c + k) % 2**64
                out[(h * 0x9E3779B97F4A7C15) % 2**64 >> 52] += 1
        return out

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1
    train = [(t, x) for i, t, x in data if not held(i) and x is not None]
    df = Counter(g for t, _ in train for g in grams(t))
    idf = {g: math.log((1 + len(train)) / (1 + df[g])) + 0.1 for g in range(language.DIM)}
    model = language.fit(spark.createDataFrame(train, "text string, lang string"))
    assert max(abs(model.idf[g] - idf[g]) for g in idf) < 1e-5 and set(model.langs) == set(words) and all(model.langs.count(x) <= 4 for x in words)
    expected = {}
    for i, t, _ in data:
        if not any(c.isalpha() for c in t or ""):
            expected[i] = ("und", 0.0)
            continue
        v = {g: math.log1p(n) * idf[g] for g, n in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(near)), key=lambda k: near[k])
        expected[i] = (model.langs[best], min(1.0, max(0.0, near[best])))
    got = language.op3_language_id(spark, path).collect()
    assert len(got) == len(data)
    for r in got:
        lang, score = expected[r["doc_id"]]
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, abs_tol=1e-4) and r["held_out"] == held(r["doc_id"])
        assert r["rejected"] == (score < 0.2)


def test_masks_find_substituted_passages(spark):
    """Recall of the seeds against the stated overlap alone: passages of twelve words and more with one word in ten replaced."""
    from larder.llm import decontam

    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    bench = [(i, [word() for _ in range(rng.randint(15, 60))]) for i in range(200)]
    rows = []
    for i, w in bench:
        changed = [word() if k % 10 == i % 10 else x for k, x in enumerate(w)]
        rows.append((i, " ".join([word() for _ in range(20)] + changed + [word() for _ in range(20)])))
    clean = [(1000 + i, " ".join(word() for _ in range(60))) for i in range(100)]
    got = decontam.decontaminate(spark.createDataFrame(rows + clean, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string"))
    hit = {r["doc_id"] for r in got.where("bench_items_ > 0").collect()}
    assert len({i for i in hit if i < 1000}) >= 0.9 * len(bench) and not [i for i in hit if i >= 1000]
