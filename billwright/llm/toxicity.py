"""Toxicity by classifier chains.

Categories are predicted one after another; a later category's linear model gets the probabilities
of the earlier ones as features. Those of its training rows are out-of-fold: they come from models that
haven't seen the row. Thresholds are the ones with the best F1 on out-of-fold probabilities.

Training uses a bounded sample of labelled rows (``SAMPLE``); scoring covers every document.
Defined cases: null and empty texts have no words and get the intercept's probability; repeated
rows get equal results; rows without an id are scored and never train; a category without both
labels in the sample gets probability one half and flags nothing.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm.ftrl import BITS, SAMPLE, fit, labelled_sample, sigmoid, word_features
from billwright.llm.jaccard import mix
from billwright.operators.settle import settle

OPTIONS = {"alpha": 1.0, "lasso": 1.0, "ridge": 0.0}
FOLDS = 4
#: Rows that one shard trains on, about.
SHARD_ROWS = 5000
#: Slots of the feature space that hold earlier categories' log-odds.
CHAIN_SLOTS = 8


def _extended(found, earlier, size):
    index, value = found
    if not len(earlier):
        return found
    return np.concatenate([index, size + np.arange(len(earlier))]), np.concatenate([value, earlier])


def _log_odds(p):
    return np.log(p / (1 - p)) / 4


def train_chain(sample, categories, bits=BITS, folds=FOLDS, shard_rows=SHARD_ROWS):
    """[(weights, threshold)] per category, in chain order.

    Every fold of every category is trained on the executors in shards, and the shards' weights are
    averaged; out-of-fold probabilities stay with the sample, in a written table."""
    spark, size = sample.sparkSession, 1 << bits
    sample = settle(sample.withColumn("earlier", F.array().cast("array<double>")), "chain-sample")
    shards = max(1, math.ceil(sample.count() / shard_rows))
    chain = []
    for category in categories:
        schema = pa.schema([("fold", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])

        def shard(batches, category=category):
            ids, labels, found = [], [], []
            for batch in batches:
                ids += batch.column("doc_id").to_pylist()
                labels += batch.column(category).to_pylist()
                found += [_extended(word_features(t, bits), e, size) for t, e in zip(batch.column("text").to_pylist(), batch.column("earlier").to_pylist(), strict=True)]
            if not ids:
                return
            key = mix(np.array(ids, dtype=np.int64).view(np.uint64))
            order, own = np.argsort(key, kind="stable"), (key >> np.uint64(40)) % np.uint64(folds)
            for fold in range(-1, folds):  # -1: on all rows
                take = [i for i in order if own[i] != fold]
                weights = fit([found[i] for i in take], [labels[i] for i in take], size + CHAIN_SLOTS, **OPTIONS)
                yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([len(take)], pa.int64()), pa.array([weights.astype(np.float32).tobytes()])], schema=schema)

        parts = sample.repartition(shards, F.xxhash64("doc_id", F.lit(7))).mapInArrow(shard, "fold int, n long, weights binary").toLocalIterator()
        models, counts = np.zeros((folds + 1, size + CHAIN_SLOTS + 1), dtype=np.float32), np.zeros(folds + 1)
        for fold, n, weights in parts:
            models[fold] += np.frombuffer(weights, dtype=np.float32) * n
            counts[fold] += n
        models /= np.maximum(counts, 1)[:, None]
        shared = spark.sparkContext.broadcast(models[:-1])  # the last is fold -1

        def outside(batches, shared=shared):
            for batch in batches:
                key = mix(np.array(batch.column("doc_id").to_pylist(), dtype=np.int64).view(np.uint64))
                own = ((key >> np.uint64(40)) % np.uint64(folds)).astype(int)
                earlier = batch.column("earlier").to_pylist()
                out = []
                for k, t, e in zip(own, batch.column("text").to_pylist(), earlier, strict=True):
                    index, value = _extended(word_features(t, bits), e, size)
                    w = shared.value[k]
                    out.append([*e, float(_log_odds(sigmoid(w[index] @ value + w[-1])))])
                i = batch.schema.get_field_index("earlier")
                columns = list(batch.columns)
                columns[i] = pa.array(out, batch.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        sample = settle(sample.mapInArrow(outside, sample.schema), "chain-sample")
        chain.append((models[-1], _threshold(sample, category)))
        shared.unpersist()
    return chain


def _threshold(sample, category, steps=99):
    """Probability with the best F1 out of fold, among hundredths."""
    p = F.expr("1 / (1 + exp(-4 * element_at(earlier, -1)))")
    counts = sample.select(F.floor(p * (steps + 1)).alias("bin"), F.col(category).alias("y")).groupBy("bin").agg(F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()
    positives, hit, n, best = sum(r["hit"] for r in counts), 0, 0, (0.0, 1.1)
    for r in counts:
        hit, n = hit + r["hit"], n + r["n"]
        f1 = 2 * hit / (n + positives) if n + positives else 0
        if f1 > best[0]:
            best = (f1, max(0.05, r["bin"] / (steps + 1)))
    return best[1] if 0 < positives < n else 1.1


def chain_scores(docs, chain, categories, text_col="text", bits=BITS):
    """All columns of docs, p_<category> and is_<category> for every category."""
    shared, size = docs.sparkSession.sparkContext.broadcast([w for w, _ in chain]), 1 << bits
    names = [f"p_{c}" for c in categories]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def rate(batches):
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                found, earlier, ps = word_features(text, bits), [], []
                for w in shared.value:
                    index, value = _extended(found, earlier, size)
                    ps.append(float(sigmoid(w[index] @ value + w[-1])))
                    earlier.append(float(_log_odds(ps[-1])))
                out.append(ps)
            columns = [pa.array([r[k] for r in out], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    rated = docs.mapInArrow(rate, schema)
    return rated.withColumns({f"is_{c}": (F.col(f"p_{c}") >= t) for c, (_, t) in zip(categories, chain, strict=True)})


def toxicity(docs, labels, sample=SAMPLE):
    """doc_id, p_low_quality, p_toxic, is_low_quality, is_toxic: the chain over the two labelled faults, quality first."""
    faults = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    categories = ["low_quality", "toxic"]
    chain = train_chain(labelled_sample(docs, faults, categories, sample), categories)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chain_scores(own, chain, categories).drop("text")
