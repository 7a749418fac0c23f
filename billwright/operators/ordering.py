"""Running sums, numbering and look-back inside a group, without one task per group.

A plain window puts a whole partition key into one task. Every key is therefore cut into blocks by
a coarse, order-preserving expression: each block is numbered on its own, and the block totals
(from a pass that reads only the keys, the block and the value) supply the offset. Only the offsets of blocks behind a first one are
written, which most keys have none of; the wide rows are exchanged once, by key and block. An input that is costly to compute should be
settled by the caller. Null keys and null blocks are keys and blocks like others (null first).

Where every key is known to be small (``large_keys`` finds the others), blocks only cost exchanges:
with ``block=None`` a plain window numbers each key, and rows that already lie together by key stay where they are.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright.operators.settle import settle


def with_edges(rows, keys, edges, value):
    """rows joined to ``value`` of their block; edges is one row per key and block. Written, as it comes from a pass of its own."""
    named = settle(edges.select(*keys, "_block", value), "edges").select(*[F.col(k).alias(f"_nb_key{i}") for i, k in enumerate(keys)], F.col("_block").alias("_nb_block"), value)
    match = F.col("_block").eqNullSafe(F.col("_nb_block"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_nb_key{i}"))
    return rows.join(named, match, "left").drop("_nb_block", *[f"_nb_key{i}" for i in range(len(keys))])


def large_keys(rows, keys, most):
    """Keys with more than ``most`` rows, written: there are few, as each stands for many rows."""
    return settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select(*keys), "large-keys")


def running_sum(df, keys, order, value, out, block):
    """Sum of ``value`` over the rows of the key up to and including this one; without blocks, each key is one task's."""
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.sum(value).over(whole))
    rows = df.withColumn("_block", block)
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    # First blocks, all there is of most keys, need no offset.
    offsets = totals.withColumn("_offset", F.sum("_total").over(before)).where("_offset is not null")
    numbered = with_edges(rows.withColumn("_local", F.sum(value).over(local)), keys, offsets, "_offset")
    return numbered.withColumn(out, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).drop("_local", "_offset", "_block")


def number_rows(df, keys, order, out, block):
    """1, 2, 3 … inside each key, in the given order."""
    return running_sum(df, keys, order, F.lit(1), out, block).withColumn(out, F.col(out).cast("int"))


def previous(df, keys, order, value, out, block):
    """Value of the row before this one inside the key; needs a value that never falls in the order."""
    rows = df.withColumn("_block", block)
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block")
    edges = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_last")).withColumn("_edge", F.lag("_last").over(before)).where("_edge is not null")
    looked = with_edges(rows.withColumn("_local", F.lag(value).over(local)), keys, edges, "_edge")
    return looked.withColumn(out, F.coalesce("_local", "_edge")).drop("_local", "_edge", "_block")


def first_row(df, keys, order):
    """First row of each key. Spark limits each map task to its own first row before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_rows(df, keys, order, n):
    """First n rows of each key, limited before the shuffle in the same way."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
