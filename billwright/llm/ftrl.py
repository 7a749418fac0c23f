"""Logistic regression over hashed word n-grams, trained online with follow-the-regularised-leader updates.

Training runs in shards on a bounded sample of labelled rows; each shard streams its documents and
keeps only its features, the weights of the shards are averaged by document count, and scores are
sparse dot products against the broadcast weights (``2 ** bits`` floats).
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm.arrow import bounded_batches, pieces
from billwright.llm.decontamination import words
from billwright.llm.jaccard import mix

BITS = 18
#: Labelled rows used for training at most; the rows with the least hash of their id are taken.
SAMPLE = 20_000
#: Rows that one shard trains on, about.
SHARD_ROWS = 2500
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


def _hashed(tokens, seed):
    if not len(tokens):
        return np.empty(0, dtype=np.uint64)
    flat = np.empty(len(tokens), dtype=object)
    flat[:] = tokens
    return mix(pd.util.hash_array(flat, categorize=False) + np.uint64(seed))


def _pairs(keys):
    return mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + keys[1:]) if len(keys) > 1 else keys[:0]


def style_features(text, bits=BITS):
    """N-grams of word shapes (letters by case, digits, punctuation, runs joined) and of words, as shares of the text, and shares of repeated words, pairs and lines."""
    data = (text or "").encode()
    shape = np.frombuffer(data.translate(_SHAPE), dtype=np.uint8)
    shapes = _hashed(shape[np.concatenate([[True], shape[1:] != shape[:-1]])].tobytes().split() if len(shape) else [], 1)
    word = _hashed(data.lower().split(), 2)
    ends = mix(_hashed([w[-2:] for w in data.split()], 5))
    n = max(1, len(word))
    lines = [x for x in data.split(b"\n") if x.strip()]
    families = [shapes, _pairs(shapes), ends, word, _pairs(word)]
    index, value = [], []
    for keys in families:
        found, counts = np.unique(keys >> np.uint64(64 - bits), return_counts=True)
        index.append(found.astype(np.int64))
        value.append(np.sqrt(counts / n))
    again = lambda keys: 1 - len(np.unique(keys)) / len(keys) if len(keys) else 0.0
    dense = [again(word), again(_pairs(_pairs(word))), 1 - len(set(lines)) / max(1, len(lines)), float(not len(word)), min(1.0, len(word) / 20)]
    index.append(np.arange(len(dense)))
    value.append(np.array(dense))
    return np.concatenate(index), np.concatenate(value).astype(np.float64)


def word_features(text, bits=BITS, prefixes=(4, 5, 6, 7)):
    """Presence of words and of their beginnings."""
    distinct = list(set(words(text)))
    keys = [_hashed(distinct, 3)]
    keys += [_hashed(list({w[:k] for w in distinct if len(w) > k}), 10 + k) for k in prefixes]
    index = np.unique(np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)
    return index, np.ones(len(index))


@dataclass
class Follow:
    """State of the per-coordinate follow-the-regularised-leader update with lasso and ridge terms."""

    size: int
    alpha: float = 0.3
    beta: float = 1.0
    lasso: float = 0.2
    ridge: float = 0.5

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)  # the last is the intercept

    def weights(self, index):
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.lasso, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.ridge)

    def learn(self, index, value, label):
        index, value = np.append(index, self.size), np.append(value, 1.0)
        w = self.weights(index)
        g = (sigmoid(w @ value) - label) * value
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        np.add.at(self.z, index, g - sigma * w)
        np.add.at(self.n, index, g * g)

    def all(self):
        return self.weights(np.arange(self.size + 1))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(features, labels, size, epochs=4, **options):
    """Weights, the intercept last, of one shard's documents in the order given."""
    model = Follow(size, **options)
    for _ in range(epochs):
        for (index, value), label in zip(features, labels, strict=True):
            model.learn(index, value, label)
    return model.all()


def labelled_sample(docs, labels, label_col, sample=SAMPLE, id_col="doc_id", text_col="text", keep=None):
    """(doc_id, text, label) of at most ``sample`` labelled rows; rows without an id, a text or a label don't train."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(c) for c in label_col]).dropna()
    marked = marked.dropDuplicates(["doc_id"])
    if keep is not None:
        marked = marked.where(keep)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return own.join(F.broadcast(chosen), "doc_id")


def train(sample, label_col, features, bits=BITS, shard_rows=SHARD_ROWS, **options):
    """Averaged weights of shards dealt by document id; an empty sample gives zero weights."""

    def shard(batches):
        texts, labels, ids = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            labels += batch.column(label_col).to_pylist()
            texts += [(index.astype(np.int32), value) for index, value in map(features, batch.column("text").to_pylist())]
        if ids:
            order = np.argsort(mix(np.array(ids, dtype=np.int64).view(np.uint64)), kind="stable")
            weights = fit([texts[i] for i in order], [labels[i] for i in order], 1 << bits, **options)
            weights = weights.astype(np.float32)
            places = np.flatnonzero(weights).astype(np.int32)  # a shard knows few of all features
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([places.tobytes()], pa.binary()), pa.array([weights[places].tobytes()], pa.binary())], names=["n", "places", "weights"])

    bounded_batches(sample.sparkSession)
    shards = max(1, math.ceil(sample.count() / shard_rows))
    parts = sample.repartition(shards, F.xxhash64("doc_id", F.lit(7))).mapInArrow(shard, "n long, places binary, weights binary").collect()
    total = sum(p["n"] for p in parts)
    out = np.zeros((1 << bits) + 1, dtype=np.float32)
    for p in parts:
        out[np.frombuffer(p["places"], dtype=np.int32)] += np.frombuffer(p["weights"], dtype=np.float32) * np.float32(p["n"] / total)
    return out


def score(docs, weights, features, text_col="text", out="score"):
    """All columns of docs and the probability of label 1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(batches):
        w = shared.value
        for batch in pieces(batches, text_col, rows=500, size=1 << 20):  # features are many times their text
            found = [features(t) for t in batch.column(text_col).to_pylist()]
            p = sigmoid(np.array([w[i] @ v + w[-1] for i, v in found], dtype=np.float64).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
