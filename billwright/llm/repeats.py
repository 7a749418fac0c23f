"""Removal of repeated byte strings: suffixes in radix order, through a fixed depth.

A byte goes when a string of ``depth`` bytes that covers it also starts anywhere else in the corpus.
The suffixes that start a repeated string are found by most-significant-digit passes that stop at
the depth and let every suffix go whose group has one member:

1. Suffixes are taken at anchors: the position of the least key among the digits (half the depth
   long) that start inside a window, so equal windows have equal anchors, and an anchor stands for
   the run of windows that chose it. The first digit of an anchor's suffix groups anchors; single
   ones leave. Equal digits reaching over everything the run's windows cover settle the run at once.
2. The windows of anchors that are neither single nor settled (they lie where a repeat begins or
   ends) are cut into slices; the digit common to a slice's windows groups slices, and
   the remaining bytes, through the depth and no further, order the windows inside.

Groups of equal windows of two or more are exactly the repeated strings. Equal members are combined inside a
task before the shuffle, which leaves one row per task of a group that a third of the corpus
shares. Keys are two 64-bit polynomial digests of different lengths over the same bytes; texts
never travel, but for the documents of step 2 and those that lose bytes.

Equal texts are one node; a text of at least ``depth`` bytes that occurs twice goes as a whole.
Defined cases: a null text is empty; shorter texts lose nothing; repeated rows remove each other;
rows without an id are treated like others.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from billwright.llm.arrow import pieces
from billwright.llm.jaccard import mix
from billwright.operators.settle import settle

DEPTH = 200
SLICE = 16
#: Windows of a very long text are taken in blocks of this many.
BLOCK = 1 << 21
#: Lists of document ids up to this count are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_LOW = np.uint64((1 << 28) - 1)


class Digests:
    """Digests of any piece of a byte string from running sums: sum(T[byte] * B^i) * B^-start modulo 2^64."""

    _table = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
    _base = 0x9E3779B97F4A7C15
    _powers = _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, n):
        if len(cls._powers) <= n:
            size = max(n + 1, 2 * len(cls._powers))
            up = np.full(size, cls._base, dtype=np.uint64)
            down = np.full(size, pow(cls._base, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            cls._powers, cls._inverse = np.cumprod(up), np.cumprod(down)

    def __init__(self, data):
        self._grow(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._table[data] * self._powers[: len(data)], out=self.sums[1:])

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self._inverse[start])


def node_of(data):
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def anchors(data, depth):
    """(first digit, digest of all a run covers, first window, last window, anchor) of every run of windows."""
    half = depth // 2
    digests, n = Digests(data), len(data) - depth + 1
    at = np.arange(len(data) - half + 1)
    first = digests.of(at, at + half)
    least = (first >> np.uint64(28) << np.uint64(28)) | at.astype(np.uint64)
    width, span = depth - half + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:n], least[width - span : width - span + n])
    chosen = (least[:n] & _LOW).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    high = np.concatenate([low[1:], [n]]) - 1
    pos = chosen[low]
    whole = mix(digests.of(low, high + depth) + ((pos - low) * (depth + 1) + (high - low)).astype(np.uint64))
    return first[pos], whole, low, high, pos


def _windows_in_blocks(data, depth):
    for start in range(0, len(data) - depth + 1, BLOCK):
        yield start, data[start : start + BLOCK + depth - 1]


def _first_of_equal(*keys):
    """Order by keys (first is most significant), group starts and group sizes in that order."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(fresh)
    return order, starts, np.diff(np.concatenate([starts, [len(order)]]))


def _merged(node, start, end):
    """Touching and overlapping intervals of a node joined."""
    order = np.lexsort((start, node))
    node, start, end = node[order], start[order], end[order]
    if not len(node):
        return node, start, end
    far = np.int64(1) << 40
    _, owner = np.unique(node, return_inverse=True)
    reach = np.maximum.accumulate(end + owner * far)
    fresh = np.concatenate([[True], (start + owner * far)[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    last = np.concatenate([at[1:], [len(node)]]) - 1
    return node[at], start[at], reach[last] - owner[last] * far


_BLOBS = "part int, a binary, b binary, c binary, d binary, e binary, f binary"
_BLOB_SCHEMA = pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in "abcdef"])
_COVER = "node long, kind int, start long, stop long, pos long"
_COVER_SCHEMA = pa.schema([("node", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("pos", pa.int64())])


def _blobs(part, columns, cover, bits):
    """Blob rows: columns cut by part, and found intervals under negative parts, by node."""
    rows = []
    for sign, at, held in ((1, part, columns), (-1, (cover[0] & np.int64((1 << bits) - 1)).astype(np.int32) + 1, cover)):
        order = np.argsort(at, kind="stable")
        at = at[order]
        held = [c[order] for c in held]
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]) if len(at) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = [np.ascontiguousarray(c[lo:hi]).tobytes() for c in held]
            rows.append((sign * int(at[lo]), *own, *[b""] * (6 - len(own))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOB_SCHEMA)], schema=_BLOB_SCHEMA)


def _read(table, types):
    columns = [np.concatenate([np.frombuffer(x.as_buffer(), dtype=t) for x in table.column(c)]) for c, t in zip("abcdef", types)]
    return columns


def _cover(node, start, stop, kind=0, pos=None):
    n = len(node)
    return pa.Table.from_arrays([pa.array(node, pa.int64()), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(np.zeros(n, dtype=np.int64) if pos is None else pos, pa.int64())], schema=_COVER_SCHEMA)


def _passed(table):
    node, start, stop = _read(table, (np.int64, np.uint32, np.uint32))
    return _cover(*_merged(node, start.astype(np.int64), stop.astype(np.int64)))


def _bits(spark):
    return min(14, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def first_pass(docs, depth=DEPTH):
    """Intervals found (kind 0) and open runs of windows (kind 1: first and last window, anchor)."""
    bits = _bits(docs.sparkSession)

    def emit(batches):
        seen = set()
        for batch in pieces(batches, "text"):
            found, nodes = [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                if len(data) < depth or (node := node_of(data)) in seen:
                    continue
                seen.add(node)
                for start, block in _windows_in_blocks(np.frombuffer(data, dtype=np.uint8), depth):
                    first, whole, low, high, pos = anchors(block, depth)
                    found.append((first, whole, low + start, high + start, pos + start))
                    nodes.append(np.full(len(first), node, dtype=np.int64))
            if not nodes:
                continue
            node = np.concatenate(nodes)
            first, whole, low, high, pos = map(np.concatenate, zip(*found, strict=True))
            order, starts, size = _first_of_equal(first, whole)
            several = np.repeat(size > 1, size)
            same = order[several]
            cover = _merged(node[same], low[same], high[same] + depth)
            head = order[starts]
            columns = [node[head], first[head], whole[head], low[head].astype(np.uint32), np.stack([high - low, pos - low], axis=1)[head].astype(np.uint8), (size > 1).astype(np.uint8)]
            part = (first[head] >> np.uint64(64 - bits)).astype(np.int32)
            yield from _blobs(part, columns, [cover[0], cover[1].astype(np.uint32), cover[2].astype(np.uint32)], bits)

    def meet(table):
        if table.column("part")[0].as_py() < 0:
            return _passed(table)
        node, first, whole, low, shape, many = _read(table, (np.int64, np.uint64, np.uint64, np.uint32, np.uint8, np.uint8))
        low, shape = low.astype(np.int64), shape.reshape(-1, 2).astype(np.int64)
        order, starts, size = _first_of_equal(first, whole, node, low)  # a text may come from several tasks
        many = np.maximum.reduceat(many[order], starts)
        order = order[starts]
        node, first, whole, low, high, pos = node[order], first[order], whole[order], low[order], (low + shape[:, 0])[order], (low + shape[:, 1])[order]
        fresh = np.concatenate([[True], first[1:] != first[:-1]])
        cut = fresh | np.concatenate([[True], whole[1:] != whole[:-1]])
        run = np.cumsum(cut) - 1
        settled = ((np.bincount(run) > 1) | (np.bincount(run, weights=many) > 0))[run]
        group = np.cumsum(fresh) - 1
        single = (np.bincount(group) == 1)[group]
        waiting = ~settled & ~single
        partner = cut & settled & (np.bincount(group, weights=waiting) > 0)[group]
        again = waiting | partner
        return pa.concat_tables([
            _cover(node[settled], low[settled], high[settled] + depth), _cover(node[again], low[again], high[again], 1, pos[again]),
        ])

    return docs.select("text").mapInArrow(emit, _BLOBS).groupBy("part").applyInArrow(meet, _COVER)


def second_pass(opened, depth=DEPTH, slice_windows=SLICE):
    """Intervals found among the windows of open runs; opened has node, text and the node's runs."""
    bits = _bits(opened.sparkSession)

    def emit(batches):
        for batch in pieces(batches, "text"):
            held = []
            for node, text, runs in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "runs")), strict=True):
                data = (text or "").encode()
                if node_of(data) != node:
                    continue
                digests = Digests(np.frombuffer(data, dtype=np.uint8))
                low, high, pos = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("start", "stop", "pos"))
                count = high - low + 1
                window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                anchor = np.repeat(pos, count)
                q = (anchor - window) // slice_windows
                left = anchor - q * slice_windows
                core = mix(digests.of(left, left + depth - slice_windows + 1) + q.astype(np.uint64))
                held.append((core, digests.of(window, window + depth), np.full(len(window), node, dtype=np.int64), window))
            if not held:
                continue
            core, key, node, window = map(np.concatenate, zip(*held, strict=True))
            order, starts, size = _first_of_equal(core, key)
            same = order[np.repeat(size > 1, size)]
            cover = _merged(node[same], window[same], window[same] + depth)
            head = order[starts]
            many = (size > 1).astype(np.uint8)
            back = np.lexsort((window[head], node[head], core[head]))  # a slice's windows side by side
            head, many = head[back], many[back]
            fresh = np.concatenate([[True], (core[head][1:] != core[head][:-1]) | (node[head][1:] != node[head][:-1])])
            yield from _slices(core[head], node[head], window[head], key[head], many, fresh, cover)

    def _slices(core, node, window, key, many, fresh, cover):
        at = np.flatnonzero(fresh)
        part = (core >> np.uint64(64 - bits)).astype(np.int32)
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        rows = []
        low = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, 3:]
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
            counts = np.diff(np.concatenate([own, [hi]])).astype(np.uint32)
            gaps = (window[lo:hi] - np.repeat(window[own], counts)).astype(np.uint32)
            gaps = (gaps << np.uint32(1)) | many[lo:hi]
            rows.append((int(part[lo]), core[own].tobytes(), node[own].tobytes(), window[own].astype(np.uint32).tobytes(), counts.tobytes(), low[lo:hi].tobytes(), gaps.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOB_SCHEMA)], schema=_BLOB_SCHEMA)
        yield from _blobs(np.empty(0, dtype=np.int32), [], [cover[0], cover[1].astype(np.uint32), cover[2].astype(np.uint32)], bits)

    def meet(table):
        if table.column("part")[0].as_py() < 0:
            return _passed(table)
        core, node, base, counts, low, gaps = _read(table, (np.uint64, np.int64, np.uint32, np.uint32, np.uint8, np.uint32))
        core, node, base = (np.repeat(c, counts) for c in (core, node, base))
        key = np.zeros((len(core), 8), dtype=np.uint8)
        key[:, 3:] = low.reshape(-1, 5)
        key, many, window = key.view(np.uint64).ravel(), gaps & 1, base.astype(np.int64) + (gaps >> 1)
        order, starts, _ = _first_of_equal(core, key, node, window)
        many, order = np.maximum.reduceat(many[order], starts), order[starts]
        core, key, node, window = core[order], key[order], node[order], window[order]
        group = np.cumsum(np.concatenate([[True], (core[1:] != core[:-1]) | (key[1:] != key[:-1])])) - 1
        found = ((np.bincount(group) > 1) | (np.bincount(group, weights=many) > 0))[group]
        return _cover(*_merged(node[found], window[found], window[found] + depth))

    return opened.mapInArrow(emit, _BLOBS).groupBy("part").applyInArrow(meet, _COVER)


def _ids(frame):
    """A list of row keys, marked for broadcast only when it is short."""
    ids = settle(frame, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def text_nodes(keyed):
    """(row_key, doc_id, n_bytes, node) of every row."""
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("node", pa.int64())])

    def name(batches):
        for batch in batches:
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(map(node_of, data), pa.int64())], schema=schema)

    return keyed.select("row_key", "doc_id", "text").mapInArrow(name, "row_key long, doc_id long, n_bytes long, node long")


def remove_repeats(docs, id_col="doc_id", text_col="text", depth=DEPTH):
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null where all or none remain)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("row_key", F.coalesce("doc_id", F.xxhash64("text")))
    rows = settle(text_nodes(keyed), "texts")
    found = settle(first_pass(keyed, depth), "first-pass")

    opened = found.where("kind = 1").groupBy("node").agg(F.collect_list(F.struct("start", "stop", "pos")).alias("runs"))
    opened = rows.where(F.col("n_bytes") >= depth).groupBy("node").agg(F.min("row_key").alias("row_key")).join(opened, "node")
    opened = settle(opened, "open")
    near = keyed.select("row_key", "text").join(_ids(opened.select("row_key").distinct()), "row_key", "left_semi")
    late = second_pass(near.join(opened, "row_key").select("node", "text", "runs"), depth)
    covers = found.where("kind = 0").unionByName(late)
    covers = covers.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))

    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"))
    judged = rows.join(copies, "node").join(covers, "node", "left").withColumn("whole", (F.col("_rows") > 1) & (F.col("n_bytes") >= depth))
    judged = settle(judged.drop("_rows"), "judged")
    by_key = judged.groupBy("row_key").agg(F.min("whole").alias("gone"), F.max(F.col("whole") | F.col("cuts").isNotNull()).alias("cut"))
    touched = _ids(by_key.where("cut").select("row_key", "gone"))
    gone = judged.join(touched.where("gone").select("row_key"), "row_key", "left_semi").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    same = keyed.join(touched, "row_key", "left_anti").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    partly = touched.where("not gone").select("row_key")
    parts = keyed.select("row_key", "text").join(partly, "row_key", "left_semi")
    parts = parts.join(judged.join(partly, "row_key", "left_semi").dropDuplicates(["row_key", "node"]), "row_key")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batches):
        for batch in pieces(batches, "text"):
            out = []
            for text, node, doc_id, whole, cuts in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "doc_id", "whole", "cuts")), strict=True):
                data = (text or "").encode()
                if node_of(data) != node:
                    continue
                spans = sorted((c["start"], c["stop"]) for c in cuts or ()) if not whole else [(0, len(data))]
                kept, last, n = [], -1, 0
                for start, stop in spans:
                    if start > last:
                        kept.append(data[max(last, 0) : start])
                        n += 1
                    last = max(last, stop)
                kept = b"".join(kept) + data[max(last, 0) :]
                out.append((doc_id, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    partial = parts.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return same.unionByName(gone).unionByName(partial)
