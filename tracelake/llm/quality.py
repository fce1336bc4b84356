"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Null and empty texts hold no n-gram and get the score of the bias alone. Very long texts are hashed in pieces.
Rows that repeat get the same score each time. A document with several labels counts by their mean. A score of exactly 0.5 counts as 1.
An empty table gives no rows, and without labels every score is 0.5.
Columns of the input other than the named ones take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common


#: Bytes of text whose n-grams are held at once: they take some forty times as much.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Training:
    """train_rows bounds the labelled documents read for training; the rest of the labels is left out by a hash of the id."""

    bits: int = 18
    train_rows: int = 12_000
    shards: int = 6
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows and where each row's begin.

    A word gives five: the word, the pair with the word before, its shape, and the pair and triple of shapes that
    end in it; a pair also says whether both words are the same. Pairs do not reach over the start of a row.
    """
    words, starts, shapes = common.hash_words(data, offsets, shapes=True)
    n = len(words)
    position = np.arange(n) - np.repeat(starts[:-1], np.diff(starts)) if n else np.zeros(0, np.int64)

    def before(values: np.ndarray, k: int) -> np.ndarray:
        moved = np.zeros(n, np.uint64)
        moved[k:] = values[:-k] if n > k else 0
        return np.where(position >= k, moved, np.uint64(0))

    last, shape1, shape2 = before(words, 1), before(shapes, 1), before(shapes, 2)
    same = (words == last).astype(np.uint64)
    salt = [np.uint64(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for x in range(1, 8)]
    grams = [
        words,
        words * salt[1] + last,
        shapes ^ salt[2],
        (shapes * salt[3] + shape1) ^ same,
        (shapes * salt[4] + shape1) * salt[5] + shape2,
    ]
    out = np.empty((n, len(grams)), np.int64)
    for i, g in enumerate(grams):
        out[:, i] = (common.mix(g + salt[i]) >> np.uint64(64 - bits)).astype(np.int64)
    return out.ravel(), starts * len(grams)


def fit_shard(texts: pa.Array, labels: np.ndarray, how: Training) -> np.ndarray:
    """Weights (the last one is the bias) after some passes of FTRL-proximal updates, one document at a time."""
    size = 1 << how.bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    data, offsets = common.text_bytes(texts)
    rows = []
    for a, b in common.row_blocks(offsets, BLOCK):
        grams, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], how.bits)
        for i in range(b - a):
            own, count = np.unique(grams[at[i] : at[i + 1]], return_counts=True)
            rows.append((np.append(own, size), np.append(count / max(1, at[i + 1] - at[i]) * 8, 1.0)))
    order = np.random.default_rng(7)
    for _ in range(how.epochs):
        for i in order.permutation(len(rows)):
            own, x = rows[i]
            weight = w[own]
            g = (1 / (1 + np.exp(-np.clip(weight @ x, -35, 35))) - labels[i]) * x
            old = n[own]
            new = old + g * g
            zs = z[own] + g - (np.sqrt(new) - np.sqrt(old)) / how.alpha * weight
            z[own], n[own] = zs, new
            w[own] = np.where(np.abs(zs) <= how.l1, 0, -(zs - np.sign(zs) * how.l1) / ((how.beta + np.sqrt(new)) / how.alpha + how.l2))
    return w


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, how: Training = Training()) -> np.ndarray:
    """Weights learnt from (doc_id, text) and (doc_id, quality 0/1), from the rows where ``use`` (on doc_id) holds.

    Shards learn apart, each in a task, and their weights are averaged: how.shards arrays of 2**bits numbers reach
    the driver, whatever the size of the input. Without any label every score is 0.5.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(use if use is not None else F.lit(True))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(how.train_rows)
    # at most train_rows pairs of numbers, so the broadcast has a fixed bound
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(how.shards)).alias("shard"), "doc_id", "text", "quality")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        w = fit_shard(pa.array(part["text"], pa.binary()), part["quality"].to_numpy(float), how)
        return pd.DataFrame({"n": [len(part)], "w": [w.astype(np.float32).tobytes()]})

    models = rows.groupBy("shard").applyInPandas(learn, "n long, w binary").collect()
    if not models:
        return np.zeros((1 << how.bits) + 1, np.float32)
    return np.average([np.frombuffer(m.w, np.float32) for m in models], axis=0, weights=[m.n for m in models]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], bits: int = Training.bits) -> DataFrame:
    """The columns in ``keep`` and ``score`` (0 to 1): a sparse dot product of each whole text's n-gram counts."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.select(*keep, F.col("text").cast("binary").alias("__text"))
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(len(keep)))
            sums, sizes = np.zeros(len(batch)), np.zeros(len(batch))
            for a, b in common.row_blocks(offsets, BLOCK):
                grams, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                total = np.concatenate([[0.0], np.cumsum(w[grams])])
                sums[a:b], sizes[a:b] = total[at[1:]] - total[at[:-1]], np.diff(at)
            margin = sums * 8 / np.maximum(sizes, 1) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], [*keep, "score"])

    return kept.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, use: Column | None, keep: list[str], how: Training = Training()) -> DataFrame:
    """``keep``, score and predicted (1 where score >= 0.5) for every row of docs, by a model learnt from ``labels``."""
    scored = score(docs, train(docs, labels, use, how), keep, how.bits)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
