"""LM scoring: a trigram model as a weighted automaton with failure arcs, walked in blocks of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, fold, free, hashes_of, table, word_bytes

END, START = np.uint64(1), np.uint64(2)  # symbols besides the words' 64-bit hashes
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, rows array<long>, ids array<{kind}>, trains array<boolean>, leads array<int>, lens array<int>, names binary, flat binary"


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; small ones cost little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and the place of each value among them, in half the bytes."""
    values, where = np.unique(x, return_inverse=True)
    return values, where.astype(np.int32)


def _blocks(most: int):
    """mapInPandas: texts as one row for each block of about ``most`` symbols.

    A block holds its different symbols' hashes and its stretches of text, as numbers of these. A stretch begins with
    the one or two symbols of state (``leads``) it is entered with, so a long text goes on in the next block from
    the state it was left in and no row grows with a text.
    """

    def emit(block: int, held: list) -> pd.DataFrame:
        names, flat = _distinct(np.concatenate([h for *_, h in held]))
        rows, ids, trains, leads, parts = (list(x) for x in zip(*held, strict=True))
        whole = {"block": block, "rows": rows, "ids": ids, "trains": trains, "leads": leads, "lens": [len(h) for h in parts], "names": names.tobytes(), "flat": _pack(flat)}
        return pd.DataFrame({k: [v] for k, v in whole.items()})

    def make(batches) -> Iterator[pd.DataFrame]:
        block = row = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for i, t, train in zip(batch["id"].astype(object), batch["text"], batch["train"], strict=True):
                h = np.concatenate([[START], hashes_of(word_bytes(t)), [END]]).astype(np.uint64)
                lead, at = 1, 1
                while at < len(h):
                    held.append((row, None if pd.isna(i) else i, bool(train), lead, h[at - lead : at + most]))
                    size += len(held[-1][-1])
                    lead, at = 2, at + most
                    if size >= most:
                        yield emit(block, held)
                        block, held, size = block + 1, [], 0
                row += 1
        if held:
            yield emit(block, held)
        free()

    return make


class _Grams:
    """The different symbols, pairs and triples of a block: which of them stands where, and the key each is counted by."""

    def __init__(self, names: bytes, flat: bytes, lens, leads, trains, bits: int = 56):
        self.names = np.frombuffer(names, np.uint64)
        self.flat = _unpack(flat).astype(np.int32)
        lens, leads = np.asarray(lens, np.int64), np.asarray(leads, np.int64)
        n = len(self.flat)
        begin = np.cumsum(lens) - lens
        self.of = np.repeat(np.arange(len(lens), dtype=np.int32), lens)  # stretch of each place
        place = np.arange(n, dtype=np.int32) - begin.astype(np.int32)[self.of]
        self.scored = place >= leads[self.of]
        learn = np.asarray(trains, bool)[self.of]
        self.at2, self.at3 = (np.flatnonzero(place >= x).astype(np.int32) for x in (1, 2))
        k = len(self.names)
        pairs, self.pair = _distinct(self.flat[self.at2 - 1].astype(np.int64) * k + self.flat[self.at2])
        self.pair_state, self.pair_symbol = np.divmod(pairs, max(k, 1))
        at_pair = np.zeros(n, np.int32)
        at_pair[self.at2] = self.pair
        triples, self.triple = _distinct(at_pair[self.at3 - 1].astype(np.int64) * max(k, 1) + self.flat[self.at3])
        self.triple_state = triples // max(k, 1)  # the pair before the symbol
        self.triple_pair = np.zeros(len(triples), np.int32)
        self.triple_pair[self.triple] = at_pair[self.at3]
        low = np.uint64(64 - bits)
        one = _scramble(self.names * _MIX + np.uint64(1))
        two = _scramble(one[self.pair_state] * _MIX + self.names[self.pair_symbol])
        three = _scramble(two[self.triple_state] * _MIX + self.names[triples % max(k, 1)])
        words = (self.names != START).astype(np.uint64)
        ones = ((one >> low) << np.uint64(1)) | words  # the last bit tells a token from other keys
        keys = np.concatenate([ones, (two >> low) << np.uint64(1), (three >> low) << np.uint64(1)])
        self.keys, where = _distinct(keys)
        self.where = np.split(where, [k, k + len(pairs)])
        entered = (self.names == START)[self.flat] & (place == 0) & (leads[self.of] == 1)
        counted = (self.scored | entered) & learn
        counts = np.concatenate([
            np.bincount(self.flat, counted, k), np.bincount(self.pair, (self.scored & learn)[self.at2], len(pairs)), np.bincount(self.triple, (self.scored & learn)[self.at3], len(triples)),
        ])
        self.counts = np.bincount(where, counts, len(self.keys)).astype(np.uint64)
        self.learned = int((self.scored & learn).sum())


def _asks(buckets: int, bits: int):
    """mapInPandas: per block and bucket one row of the sorted keys of its n-grams, as gaps, and their training counts."""

    def make(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                g = _Grams(r.names, r.flat, r.lens, r.leads, r.trains, bits)
                ends = np.searchsorted(_bucket(g.keys, buckets, bits), np.arange(buckets + 1))
                some = [b for b in range(buckets) if ends[b] < ends[b + 1]]
                gaps = [_pack(np.diff(g.keys[ends[b] : ends[b + 1]], prepend=np.uint64(0))) for b in some]
                yield pd.DataFrame({"bucket": some, "block": r.block, "gaps": gaps, "counts": [_pack(g.counts[ends[b] : ends[b + 1]]) for b in some]})
                del g, gaps
            free()

    return make


def _bucket(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Ranges of keys of about equal size, in the order of the keys."""
    return ((keys >> np.uint64(bits - 31)) * np.uint64(buckets)) >> np.uint64(32)


def _merge(asked: pd.DataFrame) -> pd.DataFrame:
    """Counts of a bucket's keys over all blocks, given back to each block in the order it asked; words with a count."""
    keys = [np.cumsum(_unpack(g), dtype=np.uint64) for g in asked["gaps"]]
    names, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate([_unpack(c) for c in asked["counts"]]).astype(float), len(names))
    own = np.split(total[where].astype(np.uint64), np.cumsum([len(k) for k in keys])[:-1])
    words = np.zeros(len(asked), np.int64)
    words[0] = int(((names & np.uint64(1) == 1) & (total > 0)).sum())
    free()
    return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"], "totals": [_pack(x) for x in own], "words": words})


def _walk(strength: tuple[float, float], n: int, v: int, bits: int):
    """Cogrouped: a block's counts and its texts, to partial sums per stretch."""

    def walk(answers: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        r = runs.iloc[0]
        g = _Grams(r["names"], r["flat"], r["lens"], r["leads"], r["trains"], bits)
        total = np.concatenate([_unpack(x) for x in answers.sort_values("bucket")["totals"]]).astype(float)
        c1, c2, c3 = (total[w] for w in g.where)
        # Arcs of the root, then of states of one and of two symbols; a failure arc leads to the shorter state.
        root = (c1 + 0.1) / (n + 0.1 * (v + 1))
        fail1, fail2 = (np.where(c > 0, s / (c + s), 1.0) for c, s in ((c1, strength[0]), (c2, strength[1])))
        arc1 = c2 / np.maximum(c1[g.pair_state] + strength[0], 1) + fail1[g.pair_state] * root[g.pair_symbol]
        arc1 = np.where(c2 > 0, np.log10(arc1), np.log10(fail1[g.pair_state]) + np.log10(root[g.pair_symbol]))
        lower = arc1[g.triple_pair]
        arc2 = c3 / np.maximum(c2[g.triple_state] + strength[1], 1) + fail2[g.triple_state] * 10**lower
        arc2 = np.where(c3 > 0, np.log10(arc2), np.log10(fail2[g.triple_state]) + lower)
        step = np.zeros(len(g.flat))
        step[g.at2] = arc1[g.pair]
        step[g.at3] = arc2[g.triple]
        kinds = len(r["lens"])
        add = lambda x: np.bincount(g.of, np.where(g.scored, x, 0), kinds)
        return pd.DataFrame({
            "row": r["rows"], "id": r["ids"], "train": r["trains"], "t": add(1).astype(np.int64), "k": add(c1[g.flat] > 0).astype(np.int64),
            "b": add(np.log10(root)[g.flat]), "p": add(step),
        })

    return walk


def lm_scores(docs: DataFrame, train, id_col: str = "doc_id", text: str = "text", strength: tuple[float, float] = (4.0, 4.0), most: int = 1 << 20, bits: int = 56) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    The states are the histories of two, one and no symbols that training texts hold. An arc from state h to
    symbol w, if training holds hw, has weight P(w | h) = (c(hw) + s * P(w | h')) / (c(h) + s), h' being h without its
    first symbol and s the ``strength`` of the shorter history (for histories of one and two symbols). A symbol without
    an arc takes the failure arc of h, of weight s / (c(h) + s), to h'; a state not seen in training fails at no cost.
    The root's arcs hold add-0.1 unigrams over training tokens. All counts come from all training rows and stay
    distributed. The walk reads a text left to right and carries its state across blocks.

    Texts go in blocks of ``most`` symbols. A block sends one packed row of sorted keys (hashes of ``bits`` bits) and
    counts of its different n-grams to each bucket, a bucket sums them and answers with the counts in the order
    asked: a frequent n-gram costs a block one key, and buckets are ranges of the hash, so no word or history makes one larger. There
    are two buckets to each of ``spark.sql.shuffle.partitions``, so that this setting bounds the memory of a task.
    Unseen n-grams share a key with a seen one in about one of 2^``bits`` / different n-grams.

    A null or blank text is its end symbol alone. Null and repeated ids and repeated rows are rows of their own. A
    null ``train`` counts as not training. Only ``id_col`` and ``text`` are read, so other columns cannot clash. An
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = cut(src.mapInPandas(_blocks(most), _BLOCK.format(kind=kind)))
    texts = blocks.select("block", "trains", "leads", "lens", "names", "flat")
    asks = texts.mapInPandas(_asks(buckets, bits), "bucket int, block long, gaps binary, counts binary")
    answers = cut(asks.groupBy("bucket").applyInPandas(_merge, "block long, bucket int, totals binary, words long"))
    each = F.arrays_zip("trains", "lens", "leads")
    n = blocks.agg(F.sum(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + F.when(x["trains"], x["lens"] - x["leads"]).otherwise(0)))).first()[0] or 0
    v = answers.agg(F.sum("words")).first()[0] or 0
    whole = blocks.withColumnRenamed("block", "of")
    got = answers.groupBy("block").cogroup(whole.groupBy("of")).applyInPandas(_walk(strength, n, v, bits), f"row long, id {kind}, train boolean, t long, k long, b double, p double")
    out = got.groupBy("row").agg(F.first("id").alias("id"), F.first("train").alias("train"), *[F.sum(x).alias(x) for x in ("t", "k", "b", "p")])
    return out.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), F.col("t").alias("n_tokens"), F.col("k").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), F.col("p").alias("score"),
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
