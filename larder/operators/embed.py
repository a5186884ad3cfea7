"""Embedding builds: token windows of chunks, decoded, embedded by a provider in each task, checked, and put back by chunk; the commit of what is still current."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from numbers import Real
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.hashes import tagged_hash

# What texts and queries begin with for the model, and segments to a call of it.
PASSAGE, QUERY = "passage: ", "query: "
CALL = 8
# Chunks whose tokens a task holds at a time (whole texts may be long, and a batch of Spark's has 10 000 rows).
ROWS = 64


class Provider(Protocol):
    """A model as a task loads it. Tokens hold no special ones; ``decode`` gives a text for each list of tokens."""

    name: str
    version: str
    dimensions: int

    def tokenize(self, texts: list[str]) -> list[list]: ...
    def decode(self, windows: list[list]) -> list[str]: ...
    def embed(self, texts: list[str]) -> list: ...


class WordHashes:
    """A provider without a model: words as tokens, and a vector of their hashed counts. The same text gives the same vector everywhere."""

    name, version = "word-hashes", "1"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def tokenize(self, texts: list[str]) -> list[list]:
        return [re.findall(r"[^ \t-\r]+", t) for t in texts]

    def decode(self, windows: list[list]) -> list[str]:
        return [" ".join(w) for w in windows]

    def embed(self, texts: list[str]) -> list:
        out = np.zeros((len(texts), self.dimensions))
        for i, words in enumerate(self.tokenize(texts)):
            for w in words:
                out[i, int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()) % self.dimensions] += 1
        return list(out)


@dataclass(frozen=True)
class Profile:
    """What vectors were made with. Vectors of profiles with different ids are never compared."""

    provider: str
    version: str
    model: str
    dimensions: int
    digest: str
    segment: int = 480
    overlap: int = 32

    def __post_init__(self):
        if not all(isinstance(x, str) and x.strip() for x in (self.provider, self.version, self.model)):
            raise ValueError("provider, version and model must not be blank")
        if isinstance(self.dimensions, bool) or not isinstance(self.dimensions, int) or self.dimensions < 1:
            raise ValueError("dimensions must be a whole number from 1")
        if not re.fullmatch("[0-9a-f]{64}", self.digest):
            raise ValueError("digest must be 64 hexadecimal digits")
        if self.segment < 1 or not 0 <= self.overlap < self.segment:
            raise ValueError("overlap must be at least 0 and less than segment")

    @property
    def id(self) -> str:
        parts = (self.provider, self.version, self.model, self.dimensions, self.digest, self.segment, self.overlap)
        return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()

    def check(self, provider: Provider) -> None:
        """Refuse a provider other than the one of this profile."""
        if (provider.name, provider.version, provider.dimensions) != (self.provider, self.version, self.dimensions):
            raise ValueError("the provider is not the one of the profile")


def spans(n: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of windows over ``n`` tokens; none without tokens."""
    begin = 0
    while begin < n:
        yield begin, min(n, begin + size)
        if begin + size >= n:
            return
        begin += size - overlap


def checked(vectors, count: int, dimensions: int) -> np.ndarray:
    """Unit vectors (32-bit) of a provider's output; an error for another count or length, values that are no finite numbers, and zeros."""
    vectors = list(vectors)
    if len(vectors) != count:
        raise ValueError("as many vectors as texts are needed")
    for v in vectors:
        if len(v) != dimensions:
            raise ValueError("a vector has another length than the provider's")
        if not (isinstance(v, np.ndarray) and v.dtype.kind == "f") and any(isinstance(x, bool) or not isinstance(x, Real) for x in v):
            raise ValueError("vectors must hold real numbers")
    x = np.array(vectors, float).reshape(count, dimensions)
    if not np.isfinite(x).all():
        raise ValueError("vectors must hold finite numbers")
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if not (norm > 0).all():
        raise ValueError("a vector has no length")
    return (x / norm).astype(np.float32)


def _prefixed(texts: list[str], prefix: str) -> list[str]:
    return [t if t.startswith(prefix) else prefix + t for t in texts]


def segments(chunks: DataFrame, load: Callable[[], Provider], profile: Profile, prefix: str = PASSAGE, call: int = CALL) -> DataFrame:
    """(keys of ``chunks``, segment, begin, finish, text, vector, error): the token windows of each chunk's ``text`` with their vectors.

    ``load`` makes the provider once a task, and the profile must be its own. Windows of a batch's chunks go to the model ``call`` at a time, whichever chunk they are of,
    and come back to their chunks. Where a call's output is refused (``checked``), its windows have an error and no vector; the rest of the job goes on. A null or empty text has no segments.
    """
    keys = [c for c in chunks.columns if c != "text"]
    size, overlap, dims = profile.segment, profile.overlap, profile.dimensions

    def embed(batches):
        provider = load()
        profile.check(provider)
        for whole in batches:
            for begin in range(0, len(whole), ROWS):
                yield from made_of(provider, whole.iloc[begin : begin + ROWS])

    def made_of(provider, b):
        texts = [t or "" for t in b["text"]]
        groups = provider.tokenize(texts)
        if len(groups) != len(texts):
            raise ValueError("as many token lists as texts are needed")
        at = [(i, k, begin, end) for i, g in enumerate(groups) for k, (begin, end) in enumerate(spans(len(g), size, overlap))]
        for first in range(0, len(at), call):
            some = at[first : first + call]
            words = provider.decode([groups[i][begin:end] for i, _, begin, end in some])
            if len(words) != len(some) or not all(isinstance(w, str) for w in words):
                raise ValueError("a text for each window is needed")
            try:
                made, error = list(checked(provider.embed(_prefixed(words, prefix)), len(some), dims)), None
            except (ValueError, TypeError) as e:
                made, error = [None] * len(some), str(e)
            rows = b[keys].iloc[[i for i, *_ in some]].reset_index(drop=True)
            yield rows.assign(segment=[k for _, k, *_ in some], begin=[x for *_, x, _ in some], finish=[x for *_, x in some], text=words, vector=made, error=error)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name in keys)
    return chunks.mapInPandas(embed, f"{kinds}, segment int, begin int, finish int, text string, vector array<float>, error string")


def query_vectors(queries: DataFrame, load: Callable[[], Provider], profile: Profile) -> DataFrame:
    """(query_id, q): unit vectors of queries (query_id, text), each one window; a refused vector stops the job."""
    whole = Profile(profile.provider, profile.version, profile.model, profile.dimensions, profile.digest, 2**31 - 1, 0)
    got = segments(queries.select("query_id", "text"), load, whole, QUERY)
    stop = F.raise_error(F.concat(F.lit("query embedding: "), "error")).cast("array<float>")
    return got.select("query_id", F.when(F.col("error").isNull(), F.col("vector")).otherwise(stop).cast("array<double>").alias("q"))


def to_bytes(load_vector) -> Column:
    """A vector as little-endian 32-bit floats."""

    def encode(vs: pd.Series) -> pd.Series:
        return vs.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(encode, "binary")(load_vector)


def from_bytes(blob, dimensions: int) -> Column:
    """The vector of ``to_bytes``; null for bytes of another length, values that are not finite, and a length other than 1 (by 1e-5 of it, or 1e-6)."""

    def decode(bs: pd.Series) -> pd.Series:
        out = []
        for b in bs:
            v = np.frombuffer(b, "<f4") if b is not None and len(b) == 4 * dimensions else None
            good = v is not None and bool(np.isfinite(v).all()) and math.isclose(float(np.linalg.norm(v.astype(float))), 1.0, rel_tol=1e-5, abs_tol=1e-6)
            out.append(v if good else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(decode, "array<float>")(blob)


def commit(made: DataFrame, items: DataFrame, chunks: DataFrame, tasks: DataFrame, attempts: DataFrame, profile: Profile, active: str, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors to publish, tasks after, run log): what was embedded, compared with the library as it is now.

    ``made`` is (doc_id, input_hash, chunk_id, segment, begin, finish, vector, error) from the state that was read; ``items`` (doc_id, index_hash, access_status), ``chunks`` (doc_id, chunk_id, input_hash),
    ``tasks`` (doc_id, input_hash, kind, status) and ``attempts`` (doc_id, n) are read again before the commit. An item is published where the profile is still active, the item
    is available under the same hash with the same chunks, and it is indexed. One that has changed meanwhile is requeued (its task is pending), as is one with an error, until it has been tried ``most`` times: then it has failed.
    """
    want = made.groupBy("doc_id", "input_hash").agg(F.array_sort(F.collect_set("chunk_id")).alias("used"), F.max("error").alias("error"), F.count("vector").alias("vectors"))
    now = items.select("doc_id", F.col("index_hash").alias("_hash"), (F.col("access_status") == "available").alias("_there"))
    held = chunks.join(items.select("doc_id", F.col("index_hash").alias("input_hash")), ["doc_id", "input_hash"]).groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("_chunks"))
    done = tasks.where("kind = 'index_content' and status = 'completed'").select("doc_id", "input_hash", F.lit(True).alias("_indexed")).distinct()
    w = want.join(now, "doc_id", "left").join(held, "doc_id", "left").join(done, ["doc_id", "input_hash"], "left").join(attempts.select("doc_id", F.col("n").alias("_n")), "doc_id", "left")
    same = (F.col("_hash") == F.col("input_hash")) & F.col("_there") & F.col("_indexed") & (F.size(F.array_except("used", "_chunks")) == 0) & F.lit(profile.id == active)
    same = F.coalesce(same, F.lit(False))
    tried = F.coalesce("_n", F.lit(0)) + 1
    outcome = F.when(same & F.col("error").isNull(), "completed").when(tried >= most, "failed").otherwise("pending")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~same, "changed while it was embedded")
    w = w.select("doc_id", "input_hash", "vectors", outcome.alias("status"), reason.alias("reason"), tried.cast("int").alias("attempts"))
    ok = w.where("status = 'completed'").select("doc_id", "input_hash")
    published = made.join(ok, ["doc_id", "input_hash"], "left_semi").drop("error").withColumn("profile", F.lit(profile.id))
    states = w.withColumn("task_hash", tagged_hash("embed-v1", F.lit(profile.id), F.col("input_hash")))
    log = w.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "pending", "failed")], F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("vectors"))), F.lit(0)).alias("vectors"))
    return published, states, log.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "partial").otherwise("completed"))


def next_round(states: DataFrame, most: int = 3) -> DataFrame:
    """The tasks that a build tries again: pending ones that have tries left."""
    w = Window.partitionBy("doc_id").orderBy(F.col("attempts").desc())
    return states.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("status") == "pending") & (F.col("attempts") < most)).drop("_r")
