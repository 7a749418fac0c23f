"""Connected components of a link table by minimum labels and pointer jumping, each round written to the shared folder."""

from pyspark.sql import functions as F

from billwright.operators.settle import settle


def components(links, a="a", b="b"):
    """(node, label) for every node of a link; the label is the smallest node reachable. Links may repeat and point either way."""
    edges = links.where(f"{a} <> {b}").select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = settle(edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = settle(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        named = labels.select(F.col("node").alias("other"), F.col("label").alias("_near"))
        near = edges.join(named, "other").groupBy("node").agg(F.min("_near").alias("_near"))
        pulled = labels.join(near, "node", "left").select("node", F.col("label").alias("_was"), F.least("label", F.coalesce("_near", "label")).alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        moved = settle(pulled.join(above, "label", "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "_was"), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> _was").isEmpty():
            return labels
