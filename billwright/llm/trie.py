"""Prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns. Its key is its depth and two 64-bit sums (exclusive or) of hashes of
(place, role, text), so the key of any prefix is a running sum over the turns, taken in blocks; no step holds a whole
conversation, text or node in one task.

Subtree totals: the trie is cut into bands of ``BAND`` depths. A node explodes only to its ancestors inside its band,
at most BAND of them, which gives every node the total of its own band. The tops of the bands form a trie of a BAND-th
of the depth, which is rolled up the same way, so a trie of depth d takes log d rounds. The completed totals of
the tops then go to the ancestors in the band above them, again at most BAND each.

Turns are ordered by turn (null first), then by fingerprints of role and text. Defined cases: null role or text is empty; rows
without a conversation id are left out; repeated rows are turns like others; an empty table has no nodes, not even a root;
other columns are not read.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright.operators.settle import settle as write

BAND = 8
#: Turns of a conversation that one window group orders or sums up; a multiple of BAND.
BLOCK = 1024
#: Conversation ids that one row of a member list holds at most.
IDS = 4096
NODE = ["depth", "k1", "k2"]


def turns(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", settle=write):
    """conv_id, place (from 0), and of every turn two fingerprints and the bytes of its text. Turn numbers are blocks of an order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    narrow = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("e1"),
        F.xxhash64(F.lit(2), role, text).alias("e2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = settle(narrow.withColumn("_block", F.floor(F.col("turn") / BLOCK)), "turns")
    totals = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("conv_id", F.coalesce("_block", F.lit(-(1 << 62))).alias("_block"), "_first").where("_first > 0")
    inside = Window.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), "e1", "e2")
    own = rows.withColumn("_in", F.row_number().over(inside)).withColumn("_block", F.coalesce("_block", F.lit(-(1 << 62))))
    return own.join(offsets, ["conv_id", "_block"], "left").select("conv_id", (F.coalesce("_first", F.lit(0)) + F.col("_in") - 1).alias("place"), "e1", "e2", "bytes")


def rebuilt(ordered, family=5, most=9):
    """Every conversation with the first h turns of the first of its family in place of its own first h; h = crc32(id) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    turn = F.struct("place", "e1", "e2", "bytes")
    heads = ordered.where(F.col("place") < most - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("head"))
    named = ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    based = named.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,e1:bigint,e2:bigint,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    shared = based.select("conv_id", "own", "h", taken.alias("head"))
    begin = shared.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    shifted = ordered.join(shared.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("place >= h")
    rest = shifted.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "e1", "e2", "bytes")
    lengths = shared.select("conv_id", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return begin.unionByName(rest), lengths


def prefixes(rows, settle=write):
    """Per conversation and depth from 1: key k1, k2 of the prefix, p1, p2 of the one before it, and the last turn's bytes."""
    hashed = rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), "bytes",
        F.xxhash64(F.lit(3), "place", "e1", "e2").alias("z1"), F.xxhash64(F.lit(4), "place", "e2", "e1").alias("z2"),
        F.floor(F.col("place") / BLOCK).alias("_block"),
    )
    hashed = settle(hashed, "hashed")
    sums = [F.bit_xor(z).alias(x) for z, x in (("z1", "b1"), ("z2", "b2"))]
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("conv_id", "_block").agg(*sums).select("conv_id", "_block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2")).where("_block > 0")
    inside = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.withColumns({"k1": F.bit_xor("z1").over(inside), "k2": F.bit_xor("z2").over(inside)})
    full = summed.join(totals, ["conv_id", "_block"], "left").withColumns({k: F.col(k).bitwiseXOR(F.coalesce(b, F.lit(0))) for k, b in (("k1", "b1"), ("k2", "b2"))})
    return full.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "bytes")


def above(rows, step):
    """Per node whose depth is a multiple of ``step`` its ancestors of that kind in the band over it, at most BAND keys. Rows: conv_id, depth, k1, k2."""
    key = F.struct("depth", "k1", "k2")
    at = F.col("depth") / step
    tops = rows.where(F.col("depth") % step == 0)
    band = F.when(F.col("depth") % (step * BAND) == 0, F.array((at / BAND - 1).cast("long"), (at / BAND).cast("long"))).otherwise(F.array(F.floor(at / BAND)))
    grouped = tops.select("conv_id", key.alias("key"), F.explode(band).alias("band")).groupBy("conv_id", "band").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    first = F.col("band") * step * BAND
    paths = grouped.select(F.posexplode("keys").alias("n", "key"), "keys", first.alias("_first")).where("key.depth > _first and n > 0")
    return paths.groupBy("key.depth", "key.k1", "key.k2").agg(F.first(F.expr("slice(keys, 1, n)")).alias("up"))


def subtree_totals(weights, rows, values, deepest, settle=write, step=1):
    """Sums of the values over the subtree of every node. weights: depth, k1, k2 and values, for depths that are multiples of ``step``."""
    nodes = settle(weights.join(above(rows, step), NODE, "left"), "band")
    sums = [F.sum(v).alias(v) for v in values]

    def handed_up(frame):
        return frame.where("up is not null").select(F.explode("up").alias("a"), *values).groupBy("a.depth", "a.k1", "a.k2").agg(*sums)

    top = F.col("depth") % (step * BAND) == 0
    within = nodes.select(*NODE, *values).unionByName(handed_up(nodes.where(~top)).select(*NODE, *values)).groupBy(*NODE).agg(*sums)
    if step * BAND > deepest:
        return within  # one band
    within = settle(within, "in-band")
    tops = subtree_totals(within.where(top), rows, values, deepest, settle, step * BAND)
    tops = settle(tops.join(nodes.select(*NODE, "up"), NODE, "left"), "tops")
    below = handed_up(tops).select(*NODE, *values).where(~top)  # tops have theirs from the round above
    return within.where(~top).unionByName(below).unionByName(tops.select(*NODE, *values)).groupBy(*NODE).agg(*sums)


def member_digests(members):
    """Digest of the sorted, comma-joined ids per node. members: depth, k1, k2, conv_id; ids arrive in rows of at most IDS and are hashed as they come."""
    chunks = (
        members.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("part"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )
    fields = "depth long, k1 long, k2 long, ends_sha256 string"

    def digest(batches):
        own, state, done = None, None, []
        for batch in batches:
            for depth, k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if (depth, k1, k2) != own:
                    if own is not None:
                        done.append((*own, state.hexdigest()))
                    own, state = (depth, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield _table(done)
                done = []
        if own is not None:
            done.append((*own, state.hexdigest()))
            yield _table(done)

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids").mapInArrow(digest, fields)


def _table(rows):
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*NODE, "ends_sha256"])


def trie(rows, lengths, settle=write):
    """One row per node of the trie of these conversations (turn rows and lengths by conv_id), with subtree totals.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = settle(prefixes(rows, settle), "prefixes")
    lengths = settle(lengths, "lengths")
    root = {"depth": F.lit(0).cast("long"), "k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long")}
    inner = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.withColumns(root).withColumns({"bytes": F.lit(0).cast("long"), "p1": F.lit(None).cast("long"), "p2": F.lit(None).cast("long")})
    nodes = settle(inner.unionByName(top), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "nodes")
    weights = nodes.select(*NODE, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    steps = paths.select("conv_id", *NODE).unionByName(lengths.select("conv_id").withColumns(root))
    totals = subtree_totals(weights, steps, ["n_leaves", "saved_tokens"], deepest, settle)
    last = paths.select("conv_id", *NODE).unionByName(lengths.where("length = 0").select("conv_id").withColumns(root))
    ends = last.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, NODE).join(member_digests(ends), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", settle=write, rebuild=rebuilt):
    """The trie of a table of turns; ``rebuild`` may exchange turns between conversations first (None: as they are)."""
    ordered = settle(turns(conversations, id_col, turn_col, role_col, text_col, settle), "ordered")
    if rebuild is None:
        return trie(ordered, ordered.groupBy("conv_id").agg(F.count(F.lit(1)).cast("long").alias("length")), settle)
    rows, lengths = rebuild(ordered)
    return trie(rows, lengths, settle)
