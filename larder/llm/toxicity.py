"""Toxicity: SVM on gap-weighted subsequence kernels against Nyström landmarks."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, fold, free, per_class, table

DECAY, SPAN, DEGREE = 0.8, 9, 3
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
_CODES = 1 << 15  # three letters of five bits
_WEIGHTS = DECAY ** np.arange(8.0)
_KEEP = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_DROP = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122 or b == 32 or 9 <= b <= 13))
_LETTER = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 5 for b in range(256)], np.int32)
_SPACED = re.compile(rb"(?<![^ ])(?:[a-z\x80-\xff] +){2,}[a-z\x80-\xff](?![^ ])")


def pieces(text: str | None) -> set[bytes]:
    """Words of a text as lower-cased letters, other characters inside a word dropped; letters that stand alone in a row of three or more also make one word."""
    bare = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP, _DROP)
    return {w for w in bare.split() if len(w) > 2} | {m.replace(b" ", b"") for m in _SPACED.findall(bare)}


def _subsequences(words: list[bytes]):
    """For at most 8192 words: (word, code, weight) of all different three-letter subsequences within SPAN letters of each word, weights summed."""
    c = _LETTER[np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    keys = [np.empty(0, np.int32)]
    for a, b in _OFFSETS:
        n = len(c) - b
        if n > 0:
            same = np.flatnonzero(of[:n] == of[b:])
            keys.append(of[same] << 18 | c[same] << 13 | c[same + a] << 8 | c[same + b] << 3 | np.int32(b - 2))
    key = np.sort(np.concatenate(keys))  # word, code, letters skipped
    which = key >> 3
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]][: len(which)])
    weight = np.add.reduceat(_WEIGHTS[key & 7], first) if len(key) else np.empty(0)
    return which[first] >> 15, which[first] & (_CODES - 1), weight


class Landmarks:
    """Landmark strings as a table from subsequence to weights, and the Nyström map of the kernel."""

    def __init__(self, names: list[bytes]):
        self.names = names
        of, code, weight = _subsequences(names)
        norm = np.sqrt(np.bincount(of, weight**2, len(names)))
        order = np.argsort(code, kind="stable")  # by code, each with the few landmarks that hold it
        self.mark, self.weight = of[order].astype(np.int64), weight[order] / norm[of[order]]
        self.count = np.bincount(code, minlength=_CODES)
        self.start = np.cumsum(self.count) - self.count
        gram = self.kernel(names)
        val, vec = np.linalg.eigh((gram + gram.T) / 2)
        self.map = (vec / np.sqrt(np.maximum(val, 1e-3))) @ vec.T

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """The kernel: the DEGREE-th power of the cosine, itself a kernel."""
        return self.cosine(words) ** DEGREE

    def cosine(self, words: list[bytes]) -> np.ndarray:
        """Cosine of the subsequence vectors of each word and each landmark; 1 for equal words."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        for at in range(0, len(words), 8192):  # all words, in pieces of bounded size
            part = words[at : at + 8192]
            of, code, weight = _subsequences(part)
            norm = np.sqrt(np.bincount(of, weight**2, len(part)))
            near = np.flatnonzero(self.count[code])
            code, weight, times = code[near], weight[near] / norm[of[near]], self.count[code[near]]
            at_mark = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.start[code], times)
            cell = np.repeat(of[near].astype(np.int64) * len(self.names), times) + self.mark[at_mark]
            got = np.bincount(cell, np.repeat(weight, times) * self.weight[at_mark], len(part) * len(self.names))
            out[at : at + len(part)] = got.reshape(len(part), -1)
        return out

    def pooled(self, texts: list[set[bytes]], most: int = 200_000) -> np.ndarray:
        """Largest kernel of any piece of each text with each landmark; 0 for a text without pieces."""
        out, begin = np.zeros((len(texts), len(self.names)), np.float32), 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < most:
                size += len(texts[end])
                end += 1
            words = sorted(set().union(*texts[begin:end]))
            k, at = self.cosine(words), {w: i for i, w in enumerate(words)}
            for i in range(begin, end):
                if texts[i]:
                    out[i] = k[[at[w] for w in texts[i]]].max(axis=0)
            begin = end
        return out**DEGREE  # a power keeps the order, so the largest cosine gives the largest kernel

    def features(self, texts: list[set[bytes]]) -> np.ndarray:
        """Nyström features of the texts."""
        return np.c_[self.pooled(texts) @ self.map, np.ones(len(texts))]


def _noisy(piece: bytes) -> bytes:
    """The piece with one or two letters put in, picked by the piece itself."""
    rng = random.Random(piece)
    for _ in range(rng.randint(1, 2)):
        i = rng.randint(1, len(piece) - 1)
        piece = piece[:i] + bytes([rng.randrange(97, 123)]) + piece[i:]
    return piece


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Linear SVM, squared hinge, by Newton steps; labels weigh the same."""
    s, w = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for _ in range(rounds):
        on = s * (x @ w) < 1
        a = x[on] * c[on, None]
        new = np.linalg.solve(a.T @ x[on] + reg * np.eye(len(w)), a.T @ s[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * w + 0.5 * new
    return w


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope (not negative) and offset of the margin, by Newton steps with smoothed targets."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    x, b = np.c_[m, np.ones(len(m))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (t - p) - 1e-2 * b)
    return max(0.0, float(b[0])), float(b[1])


class Model:
    def __init__(self, landmarks: Landmarks | None, weights=None, slope: float = 0.0, offset: float = 0.0):
        self.landmarks, self.weights, self.slope, self.offset = landmarks, weights, slope, offset

    def margins(self, texts: list[set[bytes]]) -> np.ndarray:
        return self.landmarks.features(texts) @ self.weights

    def scores(self, texts) -> np.ndarray:
        if self.landmarks is None:
            return np.zeros(len(texts))
        out = [self.margins([pieces(t) for t in texts[at : at + 1024]]) for at in range(0, len(texts), 1024)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate([np.empty(0), *out]) + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", landmarks: int = 64, sample: int = 4000) -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (id, label 0 or 1) names; null ids and labels, and other labels, drop out.

    The model is fitted on at most ``sample`` distinct texts of each label, those of least hash: labels meet the ids
    and hashes of the texts first, and only the sample's texts are read. Landmarks are pieces (``pieces``) of these
    labelled sentences: half those that tell the labels apart best (ties by the piece), half drawn by hash. A text's
    kernel with a landmark is that of its nearest piece. The SVM learns from four fifths of the sample, each text
    as it is and with letters put into its pieces, labels kept. The last fifth, which the SVM has not seen, sets the
    logistic step from margin to probability. Rows of equal id and text count once. Without texts of both labels every score is 0.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    few = cut(per_class(read.select("_id", "h").join(known, "_id"), "h", "y", sample).select("h", "y"))
    # At most ``sample`` hashes of each of two labels.
    texts = cut(read.select("t", "h").join(F.broadcast(few), "h").groupBy("h", "y").agg(F.first("t").alias("t")))
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(None)
    spare = F.pmod(F.xxhash64("h", F.lit("spare")), F.lit(5)) == 0

    def tally(batches):
        for b in batches:
            got = pd.DataFrame({"w": [pieces(t) for t in b["t"]], "y": b["y"]}).explode("w").dropna()
            got = got.groupby(["w", "y"]).size().unstack(fill_value=0).reindex(columns=[0, 1], fill_value=0)
            yield pd.DataFrame({"w": got.index, "q": got[0].to_numpy(), "p": got[1].to_numpy()})
        free()

    seen = texts.where(~spare).mapInPandas(tally, "w binary, q long, p long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    seen = seen.where(F.col("p") + F.col("q") > 1).withColumn("o", F.xxhash64("w"))
    odds = F.sqrt("p") * (F.log((F.col("p") + 0.5) / (n[1] + 1.0)) - F.log((F.col("q") + 0.5) / (n[0] + 1.0)))
    best = seen.orderBy(odds.desc(), "w").limit(landmarks // 2).toPandas()
    some = seen.orderBy("o", "w").limit(landmarks // 2).toPandas()
    names = list(dict.fromkeys(bytes(w) for w in [*best["w"], *some["w"]]))
    if not names:
        return Model(None)
    marks = Landmarks(names)

    def embed(batches):
        for b in batches:
            found = [pieces(t) for t in b["t"]]
            for kind, held in ((0, found), (1, [{*map(_noisy, p)} for p in found])):
                yield pd.DataFrame({"h": b["h"], "kind": kind, "y": b["y"], "spare": b["spare"], "v": list(marks.features(held))})
        free()

    f = texts.withColumn("spare", spare).repartition(16, "h").mapInPandas(embed, "h long, kind int, y int, spare boolean, v array<double>").toPandas().sort_values(["h", "kind", "y"])
    x, y, own = np.array(f["v"].tolist()), f["y"].to_numpy(), f["spare"].to_numpy(bool)
    weights = _svm(x[~own], y[~own])
    own &= (f["kind"] == 0).to_numpy()
    return Model(marks, weights, *(_platt(x[own] @ weights, y[own]) if len(set(y[own])) == 2 else (1.0, 0.0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity_`` from 0 to 1, over whole texts. A null or empty text scores as one without words. A column ``toxicity_`` of the caller is replaced; rows are scored each on their own."""
    # The model, as large as its landmarks, travels with the function and by value; a broadcast would name its class, which executors may not have.
    return docs.withColumn("toxicity_", F.pandas_udf(lambda s: pd.Series(model.scores(s), dtype=float), "double")(F.coalesce(F.col(text), F.lit(""))))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity_").alias("score"), (F.col("toxicity_") >= 0.3).cast("int").alias("predicted"))
