"""Language ID: nearest of several centroids per language over TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fold, per_class, spare, table

DIM = 4096


def counts(text: str | None) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of the lower-cased letters, other characters read as one blank."""
    out = np.zeros(DIM, np.float32)
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 97) & (c <= 122) | (c >= 192), c, np.uint32(32))
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)][: len(c)]]
    for at in range(0, len(c), 1 << 16):  # whole text, bounded memory; grams count where they end
        begin = max(0, at - 2)
        h, part = np.zeros(min(len(c), at + (1 << 16)) - begin, np.uint64), c[begin : at + (1 << 16)].astype(np.uint64)
        for n in (1, 2, 3):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            x = h[max(0, at - begin - n + 1) :] * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((x >> np.uint64(52)).astype(np.int64), minlength=DIM)
    return out


def _vector(text, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means, begun from rows far from each other; returns unit centroids."""
    cent = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        cent.append(x[np.argmin((x @ np.array(cent).T).max(axis=1))])
    c = np.array(cent)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    """Inverse document frequencies and unit centroids, each with its language."""

    def __init__(self, idf, centroids, langs):
        self.idf, self.centroids, self.langs = idf, centroids, langs


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample: int = 3000, per_lang: int = 4) -> Model:
    """Fit on rows with a language. Document frequencies count every row, repeated ones too; the centroids
    of a language are fitted on at most ``sample`` of its distinct texts, those of least hash. A language is fitted in
    one task, which holds 8 KB a text. Null languages drop out; a null text counts as empty. No rows: an empty model, which rejects all.
    Only the two named columns are read, so others cannot clash."""
    rows = train.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def tally(batches):
        df, n = np.zeros(DIM), 0
        for b in batches:
            for t in b["t"]:
                df += counts(t) > 0
                n += 1
        yield pd.DataFrame({"i": np.arange(DIM + 1), "n": np.r_[df, n].astype("int64")})

    got = rows.select("t").mapInPandas(tally, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1)
    df[got["i"].to_numpy(dtype=int)] = got["n"].to_numpy()
    idf = (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 0.1).astype(np.float32)

    def embed(batches):
        for b in batches:
            yield pd.DataFrame({"l": b["l"], "o": b["_o"], "v": [_vector(t, idf).astype(np.float16).tobytes() for t in b["t"]]})

    def centre(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o")
        x = np.array([np.frombuffer(v, np.float16) for v in f["v"]], dtype=np.float32).reshape(-1, DIM)
        c = _cluster(x, per_lang).astype(np.float32)
        return pd.DataFrame({"l": f["l"].iloc[0], "i": range(len(c)), "c": [v.tobytes() for v in c]})

    some = per_class(rows, "t", "l", sample).mapInPandas(embed, "l string, o long, v binary")
    f = some.groupBy("l").applyInPandas(centre, "l string, i int, c binary").toPandas().sort_values(["l", "i"])
    cents = np.array([np.frombuffer(c, np.float32) for c in f["c"]], dtype=np.float32).reshape(-1, DIM)
    return Model(idf, cents, list(f["l"]))


def predict(docs: DataFrame, model: Model, text: str = "text", least: float = 0.2) -> DataFrame:
    """``docs`` with ``lang_`` , ``lang_score_`` (cosine, 0 to 1) and ``lang_rejected_``.

    A null text or one without a letter is ``und`` with score 0 and rejected. Otherwise the nearest
    centroid names the language; a cosine under ``least`` rejects it. Ties go to the first language. Each row is predicted on its own,
    repeated ones and null ids too; an empty table gives no rows. Columns of these three names are replaced, others are kept.
    """
    m = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.langs))

    def label(texts: pd.Series) -> pd.DataFrame:
        idf, cents, langs = m.value
        out = []
        for t in texts:
            if not langs or not any(ch.isalpha() for ch in t or ""):
                out.append(("und", 0.0, True))
                continue
            s = cents @ _vector(t, idf)
            i = int(s.argmax())
            score = float(min(1.0, max(0.0, s[i])))
            out.append((langs[i], score, score < least))
        return pd.DataFrame(out, columns=["p", "s", "r"])

    g = spare(docs, "_g")
    got = docs.withColumn(g, F.pandas_udf(label, "p string, s double, r boolean")(text))
    return got.withColumn("lang_", F.col(g)["p"]).withColumn("lang_score_", F.col(g)["s"]).withColumn("lang_rejected_", F.col(g)["r"]).drop(g)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("lang_").alias("lang_pred"), F.col("lang_score_").alias("score"), F.col("lang_rejected_").alias("rejected"))
