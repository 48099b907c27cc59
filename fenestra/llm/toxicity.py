"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (runs of letters, lower case) and the beginnings of longer ones, hashed to a fixed number of
buckets. Besides a weight, each chosen bucket has a short vector, and the products of all pairs of vectors in a text add to its score, so that two terms
can weigh together what neither weighs alone. The machine is fitted on a bounded sample of labelled rows; every text is scored whole.

A bucket is chosen if it tells the labels apart alone, or together with another one beyond what both tell alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.batches import map_batches, map_rows
from fenestra.llm.common import cut, read

BUCKETS = 1 << 18
WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Beginnings of so many bytes stand for words at least two longer.
STEMS = (4, 5, 6)
#: The sample holds at most so many rows of each label, those with the smallest hashes of their texts; equal texts of a label count once.
SAMPLE = {0: 9_000, 1: 5_000}
#: A bucket, or a pair of them, is judged if so many sampled texts have it, and chosen from so many standard deviations on.
LEAST_TEXTS, CLEAR, CLEAR_PAIR = 8, 2.5, 8.0
#: Pairs are sought among so many buckets, those in most sampled texts. The sample's size is fixed, so what this leaves out is too.
PAIRED = 4_096
FACTORS, EPOCHS, RATE, SHRINK, SEED = 6, 12, 0.05, 2e-3, 7
MEMO = 100_000


def terms(text: bytes | None, memo: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """The distinct buckets of a text's terms, ascending."""
    found: set[int] = set()
    for w in set(WORD.findall((text or b"").lower())):
        known = memo.get(w)
        if known is None:
            known = (zlib.crc32(w) % BUCKETS, *(zlib.crc32(b"^" + w[:n]) % BUCKETS for n in STEMS if len(w) >= n + 2))
            if len(memo) >= MEMO:
                memo.clear()
            if len(w) <= 64:
                memo[w] = known
        found.update(known)
    return np.array(sorted(found), np.int64)


@dataclass
class Machine:
    """A fitted machine: chosen buckets (ascending), their weights and vectors, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, found)
        at = at[(at < len(self.buckets)) & (self.buckets[np.minimum(at, len(self.buckets) - 1)] == found)] if len(self.buckets) else at[:0]
        v = self.vectors[at]
        pairs = 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + pairs, -30, 30))))


def _texts_with(labels: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of label 1, and of label 0, each bucket is in."""
    return tuple(np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == label] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for label in (1, 0))


def alone(labels: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Buckets whose log odds between the labels are CLEAR standard deviations from 0 or more."""
    in1, in0 = _texts_with(labels, rows)
    p1, p0 = (in1 + 0.5) / (labels.sum() + 1), (in0 + 0.5) / ((1 - labels).sum() + 1)
    clear = np.abs(np.log(p1 * (1 - p0) / (p0 * (1 - p1)))) / np.sqrt(1 / (in1 + 0.5) + 1 / (in0 + 0.5))
    return np.flatnonzero((clear > CLEAR) & (in1 + in0 >= LEAST_TEXTS))


def together(labels: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Buckets that stand with another one in texts whose labels are CLEAR_PAIR standard deviations or more from what the odds of both alone add up to."""
    in1, in0 = _texts_with(labels, rows)
    top = np.sort(np.argsort(-(in1 + in0), kind="stable")[:PAIRED])
    top = top[(in1 + in0)[top] >= LEAST_TEXTS]
    place = np.full(BUCKETS, -1)
    place[top] = np.arange(len(top))
    with1, with0 = (np.zeros((len(top), len(top)), np.float32) for _ in "10")
    for label, sums in ((1, with1), (0, with0)):
        own = [r for r, y in zip(rows, labels) if y == label]
        for k in range(0, len(own), 1_000):
            x = np.zeros((len(own[k : k + 1_000]), len(top)), np.float32)
            for i, r in enumerate(own[k : k + 1_000]):
                at = place[r]
                x[i, at[at >= 0]] = 1
            sums += x.T @ x
    prior = np.log(labels.sum() / (1 - labels).sum())
    odds = np.log((in1[top] + 0.5) / (in0[top] + 0.5)) - prior
    found = np.zeros(len(top), bool)
    for k in range(0, len(top), 512):
        q = 1 / (1 + np.exp(-np.clip(prior + odds[k : k + 512, None] + odds, -30, 30)))
        n = with1[k : k + 512] + with0[k : k + 512]
        far = np.abs(with1[k : k + 512] - n * q) > CLEAR_PAIR * np.sqrt(n * q * (1 - q)) + 1e-9
        far &= n >= LEAST_TEXTS
        far[np.arange(len(far)), k + np.arange(len(far))] = False
        found[k : k + 512] = far.any(axis=1)
    return top[found]


def fit(labels: np.ndarray, rows: list[np.ndarray], prior: float) -> Machine:
    """Fit on the sample's buckets by stochastic gradients with adapted rates; `prior` is the share of label 1 in all labelled rows.

    Without rows of both labels nothing is learned, and every text gets the prior.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    none = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(prior / (1 - prior))))
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return none
    chosen = np.union1d(alone(labels, rows), together(labels, rows))
    if not len(chosen):
        return none
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    data = [(p := place[r])[p >= 0] for r in rows]
    rng = np.random.default_rng(SEED)
    w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS)), np.log(n1 / n0)
    gw, gv, gb = np.full(len(chosen), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            x = data[i]
            s = v[x].sum(axis=0)
            z = b + w[x].sum() + 0.5 * (s @ s - (v[x] ** 2).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            dw, dv = g + SHRINK * w[x], g * (s - v[x]) + SHRINK * v[x]
            gw[x] += dw**2
            gv[x] += dv**2
            gb += g * g
            w[x] -= RATE * dw / np.sqrt(gw[x])
            v[x] -= RATE * dv / np.sqrt(gv[x])
            b -= RATE * g / np.sqrt(gb)
    return Machine(chosen, w, v, float(b + np.log(prior / (1 - prior)) - np.log(n1 / n0)))


def hashed_terms(labelled: DataFrame) -> DataFrame:
    """doc_id, key, label and the buckets of the text's terms for rows of these and text."""

    def work():
        memo: dict[bytes, tuple[int, ...]] = {}

        def each(doc_id, key, label, text):
            yield doc_id, key, label, terms(text, memo).astype(np.int32)

        return each

    return map_rows(labelled.select("doc_id", "key", "label", F.col("text").cast("binary")), work, "doc_id bigint, key bigint, label int, terms array<int>")


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from `docs` (doc_id, text) and `labels` (doc_id, label); rows without text or with a label other than 0 and 1 teach nothing.

    The sample is chosen by ids and hashes of texts alone; only texts of the sample are read by the fitting task, and none is shuffled.
    """
    key = F.xxhash64("text")
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", key.alias("key"))
    known = cut(keyed.join(labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")), "doc_id"))
    share = known.agg(F.avg("label")).first()[0]
    if share is None:
        return fit(np.zeros(0), [], 0.0)
    parts = [known.where(F.col("label") == y).groupBy("key").agg(F.min("doc_id").alias("doc_id")).orderBy("key").limit(most).select("doc_id", "key", F.lit(y).alias("label")) for y, most in SAMPLE.items()]
    # a bounded sample, so a broadcast is safe; a doc_id with several texts teaches with the one that was drawn
    sample = docs.select("doc_id", "text", key.alias("key")).join(F.broadcast(parts[0].union(parts[1])), ["doc_id", "key"])

    def learn(sampled: pd.DataFrame) -> pd.DataFrame:
        sampled = sampled.sort_values(["doc_id", "key", "label"])
        m = fit(sampled["label"].to_numpy(np.float64), [np.asarray(t, np.int64) for t in sampled["terms"]], float(share))
        return pd.DataFrame({"buckets": [m.buckets.tobytes()], "weights": [m.weights.tobytes()], "vectors": [m.vectors.tobytes()], "bias": [m.bias]})

    once = hashed_terms(sample).groupBy("doc_id", "key", "label").agg(F.first("terms").alias("terms"))  # rows repeat; equal texts have equal terms
    row = once.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: learn(pdf), "buckets binary, weights binary, vectors binary, bias double").first()
    return Machine(np.frombuffer(row.buckets, np.int64), np.frombuffer(row.weights), np.frombuffer(row.vectors).reshape(-1, FACTORS), row.bias)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) for each of `docs` (doc_id, text), read whole; a null text scores as an empty one.

    Repeated rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a row for each chosen bucket, BUCKETS at most

    def work():
        m, memo = shared.value, {}

        def each(doc_id, text):
            yield doc_id, m.score(terms(text, memo))

        return each

    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), work, "doc_id bigint, score double")


def learnable(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels may be learned from: crc32 of doc_id as text is no multiple of `folds`. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != 0


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `least`, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        m, memo = shared.value, {}
        for batch in batches:
            yield batch.filter(pa.array([m.score(terms((t.as_py() or "").encode(), memo)) < least for t in batch.column(place)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label (toxic) of the rows that may be learned from."""
    return labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isNotNull() & learnable(F.col("doc_id")))


def train_on_tables(spark: SparkSession, sf_dir: str) -> Machine:
    return train(read(spark, sf_dir, "documents"), learning_labels(read(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score and predicted; a null or empty text is scored as one without terms, a null doc_id counts as empty text when folds are dealt."""
    scored = score(read(spark, sf_dir, "documents"), train_on_tables(spark, sf_dir))
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
