"""Exact top-k search by inner product: ball trees per shard, searched by branch and bound.

Vectors are dealt to cells around a bounded sample of pivots and a full cell is split by id, so a shard
holds a bounded number of vectors however often one vector is repeated. Every shard builds a ball
tree. A query is first answered in its own shard; the k-th score found there travels with it to
the other shards as a bound. In a tree, leaves are taken in order of the upper bound
``q . centre + |q| * radius``, and a leaf is skipped for every query whose current k-th score is
above its bound. Queries pass through a shard in batches, so neither side is held whole.

Scores are inner products of whole numbers, ties go to the smaller id. Defined cases: a vector
that is null or holds a null or a non-finite component, or has no id, takes no part; vectors of
different lengths are not compared; rows that repeat an id are candidates each, but never for a
query with that id; of several rows with a query's id the shortest vector, then the least, asks; empty vectors score 0 with
each other; empty tables give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright.operators.settle import settle

SHARD_ROWS = 4096
#: Pivots that cells form around, at most; larger tables split their cells.
PIVOTS = 1024
LEAF = 64
_EXACT = 1 << 53


class BallTree:
    """Leaves of a ball tree: vectors in leaf order, with centre and radius of every node."""

    def __init__(self, ids, vectors, leaf=LEAF):
        self.ids, self.vectors = ids, vectors
        self.nodes = []  # (centre, radius, left, right, rows)
        self._split(np.arange(len(ids)), leaf)

    def _split(self, rows, leaf):
        points = self.vectors[rows].astype(np.float64)
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append(None)
        radius, left, right = float(away.max()), -1, -1
        if len(rows) > leaf and radius > 0:
            far = points[away.argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            along = points @ (other - far)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            left, right = self._split(rows[order[:half]], leaf), self._split(rows[order[half:]], leaf)
            rows = None
        self.nodes[me] = (centre, radius, left, right, rows)
        return me

    def search(self, query_ids, queries, bounds, k):
        """(query number, score, id) of the k best of every query; bounds are scores that k vectors elsewhere reach."""
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        spread = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, queries.shape[1])
        small = spread < _EXACT
        table, asked = (self.vectors.astype(np.float64), queries.astype(np.float64)) if small else (self.vectors, queries)
        kth, best = bounds.astype(np.float64), np.full((len(queries), k), -np.inf)
        found, held = [], 0

        def upper(node, who):
            centre, radius, *_ = self.nodes[node]
            return (queries[who] @ centre + lengths[who] * radius) + 1e-6 * (1 + np.abs(queries[who] @ centre) + lengths[who] * radius)

        # leaves with the queries that may find something there, the most promising first
        open_nodes, leaves = [(0, np.arange(len(queries)))], []
        while open_nodes:
            node, who = open_nodes.pop()
            bound = upper(node, who)
            keep = bound >= kth[who]
            who, bound = who[keep], bound[keep]
            if not len(who):
                continue
            _, _, left, right, rows = self.nodes[node]
            if rows is not None:
                leaves.append((bound.max(), node, who, bound))
            else:
                open_nodes += [(left, who), (right, who)]
        leaves.sort(key=lambda x: -x[0])
        for _, node, who, bound in leaves:
            who = who[bound >= kth[who]]
            if not len(who):
                continue
            rows = self.nodes[node][4]
            scores = asked[who] @ table[rows].T
            scores_own = np.where(query_ids[who, None] == self.ids[rows][None, :], -np.inf, scores.astype(np.float64))
            best[who] = -np.partition(-np.concatenate([best[who], scores_own], axis=1), k - 1, axis=1)[:, :k]
            kth[who] = np.maximum(kth[who], best[who].min(axis=1))
            q, r = np.nonzero((scores_own >= kth[who, None]) & np.isfinite(scores_own))
            found.append((who[q], scores[q, r].astype(np.int64), self.ids[rows[r]]))
            held += len(q)
            if held > 1_000_000:
                found = [_best(found, k)]
                held = len(found[0][0])
        return _best(found, k) if found else (np.empty(0, dtype=np.int64),) * 3


def _best(found, k):
    who, score, ids = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    start = np.searchsorted(who, who)
    keep = np.arange(len(who)) - start < k
    return who[keep], score[keep], ids[keep]


def whole_vectors(embeddings, id_col="vec_id", vector_col="embedding", scale=64):
    """(vec_id, v): components floor(scale * x) as whole numbers, of the vectors that take part."""
    x = F.col(vector_col)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.col(id_col).isNotNull() & x.isNotNull() & fit).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v")
    )


def _matrix(column, dim):
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dim)


def shards(vectors, shard_rows=SHARD_ROWS, pivots=PIVOTS):
    """(shard, dim, vec_id, v) and the number of shards of each dimension as [(dim, first, count)]."""
    spark = vectors.sparkSession
    vectors = vectors.withColumn("dim", F.size("v"))
    n = vectors.count()
    wanted = min(pivots, max(1, -(-n // shard_rows)))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    by_dim = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    shared = spark.sparkContext.broadcast({d: np.array(v, dtype=np.float64).reshape(len(v), d) for d, v in by_dim.items()})

    def deal(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), dtype=np.int64)
            cell = np.zeros(len(dims), dtype=np.int32)
            for d in np.unique(dims):
                at, centres = np.flatnonzero(dims == d), shared.value.get(int(d))
                if centres is None or not d:
                    continue
                points = _matrix(batch.column("v").take(pa.array(at)), int(d)).astype(np.float64)
                cell[at] = ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    dealt = settle(vectors.select("vec_id", "v", "dim").mapInArrow(deal, "vec_id long, v array<long>, dim int, cell int"), "cells")
    sizes = dealt.groupBy("dim", "cell").count().orderBy("dim", "cell").collect()
    plan, of_dim, first = [], {}, 0
    for r in sizes:
        parts = -(-r["count"] // shard_rows)
        plan.append((r["dim"], r["cell"], first, parts))
        of_dim.setdefault(r["dim"], [first, 0])[1] += parts
        first += parts
    plan = spark.createDataFrame(plan, "dim int, cell int, first int, parts int")
    placed = dealt.join(F.broadcast(plan), ["dim", "cell"]).withColumn("shard", F.expr("first + pmod(hash(vec_id), parts)"))
    return placed.select("shard", "dim", "vec_id", "v"), [(d, a, n) for d, (a, n) in of_dim.items()]


_FOUND = "query_id long, score long, vec_id long"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _search(lined, k):
    """lined: (shard, kind, dim, vec_id, v, bound), a shard's vectors (kind 0) before its queries (kind 1)."""

    def run(batches):
        now, ids, vectors, tree = None, [], [], None
        for batch in batches:
            shard, kind, dim = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("shard", "kind", "dim"))
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, ids, vectors, tree = shard[a], [], [], None
                own, points = np.array(part.column("vec_id").to_pylist(), dtype=np.int64), _matrix(part.column("v"), int(dim[a]))
                if kind[a] == 0:
                    ids.append(own)
                    vectors.append(points)
                    continue
                if not ids and tree is None:
                    continue
                if tree is None:
                    tree, ids, vectors = BallTree(np.concatenate(ids), np.concatenate(vectors)), [], []
                bound = np.array([-np.inf if x is None else x for x in part.column("bound").to_pylist()])
                who, score, found = tree.search(own, points, bound, k)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(score), pa.array(found)], schema=_FOUND_SCHEMA)

    return lined.sortWithinPartitions("shard", "kind").mapInArrow(run, _FOUND)


def top_k(embeddings, every=20, k=20, id_col="vec_id", vector_col="embedding", scale=64, shard_rows=SHARD_ROWS):
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by ``every``."""
    placed, spans = shards(whole_vectors(embeddings, id_col, vector_col, scale), shard_rows)
    total = sum(n for _, _, n in spans)
    placed = settle(placed, "shards")
    asking = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asking.groupBy("vec_id").agg(F.min(F.struct("dim", "v", "shard")).alias("q")).select("q.shard", "q.dim", "vec_id", "q.v")
    data = placed.select("shard", F.lit(0).alias("kind"), "dim", "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    home = queries.select("shard", F.lit(1).alias("kind"), "dim", "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    n = max(1, min(total, 4096))
    first = settle(_search(data.unionByName(home).repartition(n, "shard"), k), "home")
    if total <= 1:
        found = first
    else:
        kth = first.groupBy("query_id").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
        bounded = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        reach = F.lit(None).cast("array<int>")
        for d, a, c in spans:
            reach = F.when(F.col("dim") == d, F.sequence(F.lit(a), F.lit(a + c - 1))).otherwise(reach)
        asked = bounded.withColumn("to", F.explode(reach)).where("to <> shard")
        asked = asked.select(F.col("to").alias("shard"), F.lit(1).alias("kind"), "dim", "vec_id", "v", F.col("_least").cast("double").alias("bound"))
        found = first.unionByName(_search(data.unionByName(asked).repartition(n, "shard"), k))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
