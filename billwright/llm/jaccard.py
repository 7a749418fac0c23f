"""N-gram Jaccard join with PartEnum signatures.

Every document is the set of its distinct five-word shingles. Sets fall into size bands; a band
parts the shingle domain by hash and a set's signatures are its contents inside the enumerated
subsets of partitions. Sets of sizes a and b with a Jaccard similarity of 3/4 or more differ in at
most (a + b) / 7 <= a / 3 shingles, each of which spoils one partition, so among a / 3 + e of the
signatures, taken in a fixed order, they share e. The second level of the scheme has one part per
partition: with more, signatures multiply and outgrow the input. The guarantee asks for the same form of
signatures in both sets. Bands below RAW have single shingles as partitions, so that none is empty. In the others
a set can have too few non-empty partitions, by chance of about 1e-7 or less; where there are such thin
sets, all sets of their bands meet them once more by the signatures of single shingles.

Signatures travel as sorted byte strings, a few bytes each. A set whose shared signatures are fewer
than e has no partner and leaves; of the others, the rarest signatures that must hold a common one
make candidate groups, and only sets that share three quarters of their shingles with other candidates
stay in them. Groups are settled by stars: every member is verified against one pivot
on whole texts, components are formed, and only groups that still hold several components go on to the next pivot.
The sets left after the stars get further signatures, their rarest shingles: of the shingles that occur in several
components, two linked sets share one among those that remain of a quarter of each set, counted from the rarest, so a set whose quarter
is its own alone is done, and only sets that meet in a rare shingle are compared. No link between
components is lost, and a group of copies or near copies costs as many comparisons as it has members.

Identical sets are one node (64-bit fingerprint) throughout. Defined cases: null and empty texts,
and texts without words, have no shingles and link with nothing; a text of one to four words is
one shingle; repeated rows share a component; rows without an id take part and their component is
named by the smallest id in it.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from billwright.llm.arrow import bounded_batches, packed, pieces, unpacked
from billwright.llm.components import components
from billwright.operators.settle import settle

WORDS = 5
#: Sets below this size share one band.
SMALL = 16
#: Bands below this one (sets of fewer than 128 shingles) use the shingles themselves as partitions.
RAW = 7
#: Partitions of a band that begins at size b: PARTS * b; shared signatures asked for: SHARED * b.
PARTS, SHARED = 1.1, 0.12
#: Rounds of stars: at least, and at most as long as each leaves a quarter less to do.
STARS, MOST_STARS = 2, 10
#: Rows that a group of signatures or shingles holds on average, at most; text bytes that a task takes at once.
GROUP_ROWS, TEXT_BYTES = 2_000_000, 4 << 20
#: Rows of a group that are sorted at once, on average; characters of text whose words are held as objects at once.
SORT_ROWS, WORD_CHARS = 250_000, 1 << 19
#: Characters of text in a block of compared sets, and pairs between two blocks, on average at most.
BLOCK_CHARS, BLOCK_PAIRS = 4_000_000, 100_000
#: Candidate documents up to this count are picked from the corpus by a broadcast list of ids; more by shuffle.
BROADCAST_ROWS = 1_000_000
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x):
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts):
    """Sorted distinct shingle keys of each text."""
    texts, out, start, held = list(texts), [], 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text or "")
        if held >= WORD_CHARS or end == len(texts):
            out += _shingle_sets(texts[start:end])
            start, held = end, 0
    return out


def _shingle_sets(texts):
    found = [(t or "").encode().lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in found])
    flat = np.empty(ends[-1] if len(found) else 0, dtype=object)
    flat[:] = [w for ws in found for w in ws]
    key = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, dtype=np.uint64)
    grams = mix(sum(_C[j] * key[j : len(key) - WORDS + 1 + j] for j in range(WORDS))) if len(key) >= WORDS else key[:0]
    out = []
    for ws, end in zip(found, ends, strict=True):
        n = len(ws)
        if n >= WORDS:
            out.append(np.unique(grams[end - n : end - WORDS + 1]))
        elif n:
            out.append(mix(np.array([(_C[:n] * key[end - n : end]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(key[:0])
    return out


def node_of(keys):
    """Fingerprint of a set."""
    return int(mix(mix(keys ^ _C[1]).sum(keepdims=True) + np.uint64(len(keys))).view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([node_of(s) if len(s) else None for s in shingle_sets(texts)], dtype="Int64")


def bands_of(n):
    """Bands in which a set of n shingles meets its possible partners; band 0 is for small sets."""
    own = 0 if n < SMALL else n.bit_length() - 1
    up = n.bit_length()
    out = [own]
    if own == 0:
        return out
    if 3 * n <= 4 * (SMALL - 1):
        out.append(0)
    if 4 * n >= 3 * (1 << up):
        out.append(up)
    return out


def needed(band):
    """Signatures that two similar sets of a band share at least; raw forms of a parted band have negative numbers."""
    return max(1, int(SHARED * (1 << abs(band)))) if band else 1


def signatures(keys, band):
    """(tag, signatures): of a band's partitions or single shingles; tag -band: thin, of single shingles as empty partitions void the guarantee."""
    if band < RAW:
        return band, raw_signatures(keys, band)
    part, starts = _parted(keys, band)
    if _thin(keys, band, starts):
        return -band, raw_signatures(keys, band)
    held = np.add.reduceat(mix(keys ^ _C[2]), starts)
    return band, _least(mix(held + mix(part[starts] * _C[3] + _salt(band))), len(keys) // 3 + needed(band))


def raw_signatures(keys, band):
    """Signatures of single shingles, which every set of a band can have."""
    return _least(mix(keys + _salt(-band - 1)), len(keys) // 3 + needed(band))


def thin_bands(keys):
    """Bit per band in which a set has too few partitions."""
    return sum(1 << band for band in bands_of(len(keys)) if band >= RAW and _thin(keys, band, _parted(keys, band)[1]))


def _parted(keys, band):
    parts = max(1, int(PARTS * (1 << band)))
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))


def _thin(keys, band, starts):
    return len(starts) - len(keys) // 3 < needed(band)


def _salt(band):
    return np.uint64((band * int(_C[4])) % (1 << 64))


def _least(values, k):
    return values if k >= len(values) else np.partition(values, k - 1)[:k]


def _tables(schema, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def document_sets(docs, id_col="doc_id", text_col="text"):
    """One row per document row: doc_id, n_shingles, node (null without shingles), thin (bits of bands)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("thin", pa.int64())])

    def count(batches):
        for batch in pieces(batches, text_col, size=TEXT_BYTES):
            sets = shingle_sets(batch.column(text_col).to_pylist())
            yield _tables(schema, [batch.column(id_col).to_pylist(), [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets], [thin_bands(s) for s in sets]])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(count, "doc_id long, n_shingles long, node long, thin long")


def _signature_blobs(docs, text_col, bits):
    schema = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tags", pa.binary()), ("keys", pa.binary())])

    def emit(batches):
        seen = set()
        for batch in pieces(batches, text_col, size=TEXT_BYTES):
            nodes, sizes, owner, tags, keys = [], [], [], [], []
            for found in shingle_sets(batch.column(text_col).to_pylist()):
                node = node_of(found) if len(found) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                for band in bands_of(len(found)):
                    tag, own = signatures(found, band)
                    if tag < 0:  # thin_signatures has these
                        continue
                    keys.append(own)
                    tags.append(np.full(len(own), tag, dtype=np.int8))
                    owner.append(np.full(len(own), len(nodes), dtype=np.int32))
                nodes.append(node)
                sizes.append(len(found))
            if not keys:
                continue
            key, tag, owned = np.concatenate(keys), np.concatenate(tags), np.concatenate(owner)
            node, size = np.array(nodes, dtype=np.int64), np.array(sizes, dtype=np.int32)
            part = (key >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, tag, owned, part = (key << np.uint64(bits)) [order], tag[order], owned[order], part[order]
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            rows = []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                mine, counts = np.unique(owned[start:end], return_counts=True)
                low = np.ascontiguousarray(key[start:end]).view(np.uint8).reshape(-1, 8)[:, 3:]
                rows.append((int(part[start]), node[mine].tobytes(), size[mine].tobytes(), counts.astype(np.uint32).tobytes(), tag[start:end].tobytes(), low.tobytes()))
            yield _tables(schema, zip(*rows, strict=True))

    return docs.select(text_col).mapInArrow(emit, "part int, nodes binary, sizes binary, counts binary, tags binary, keys binary")


def _bits(rows, least, group_rows=GROUP_ROWS):
    """Bits of a key that deal so many rows to at least so many groups of bounded size."""
    return min(20, max(1, math.ceil(math.log2(max(least, rows / group_rows)))))


def shared_signatures(docs, shingles, text_col="text"):
    """(node, n, tag, sig, g): the signatures that g >= 2 different sets hold. ``shingles``: in all sets together."""
    # Few parts: a set's fingerprint and size travel once with its signatures of a part.
    bits = _bits(shingles, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) / 2)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tag", pa.int8()), ("sig", pa.int64()), ("g", pa.int32())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slices(batches, 5, nodes=np.int64, sizes=np.int32, tags=np.int8):
            node, size, tag, key = held["nodes"], held["sizes"], held["tags"], held["keys"] + (held["part"] << 40)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node, order = key[fresh], node[fresh], order[fresh]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            g = np.diff(np.concatenate([starts, [len(key)]]))
            g = np.repeat(g, g)
            keep = g > 1
            order = order[keep]
            yield _tables(schema, (node[keep], size[order], tag[order], key[keep], g[keep]))

    blobs = _signature_blobs(docs, text_col, bits)
    return blobs.groupBy("part").applyInArrow(meet, "node long, n int, tag tinyint, sig long, g int")


def _slices(batches, width, **columns):
    """The rows of one group by the last byte of their keys, SORT_ROWS at once on average; equal keys stay together.

    The group itself is held as it travelled. ``width``: bytes of a key; columns: their types, ``tags`` has a value for each key, the others for each set.
    """
    group = [(batch, i) for batch in batches for i in range(batch.num_rows)]
    view = lambda batch, i, name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
    rows = sum(len(view(batch, i, "keys", np.uint8)) // width for batch, i in group)
    edges = np.linspace(0, 256, min(256, max(1, math.ceil(rows / SORT_ROWS))) + 1).astype(np.int64)
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        found = {name: [] for name in (*columns, "keys")}
        for batch, i in group:
            low = view(batch, i, "keys", np.uint8).reshape(-1, width)
            at = np.flatnonzero((low[:, 0] >= first) & (low[:, 0] < end))
            owner = np.searchsorted(np.cumsum(view(batch, i, "counts", np.uint32)), at, side="right")
            for name, kind in columns.items():
                found[name].append(view(batch, i, name, kind)[at if name == "tags" else owner])
            key = np.zeros((len(at), 8), dtype=np.uint8)
            key[:, :width] = low[at]
            found["keys"].append(key.view(np.int64).ravel())
        found = {name: np.concatenate(arrays) for name, arrays in found.items()}
        if len(found["keys"]):
            yield found | {"part": group[0][0].column("part")[group[0][1]].as_py()}


def thin_signatures(docs, bands, text_col="text"):
    """(node, n, tag, sig, g): the single-shingle signatures of thin sets in the bands, and who else in the band holds them."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tag", pa.int8()), ("sig", pa.int64())])

    def emitted(only_thin):
        def emit(batches):
            for batch in pieces(batches, text_col, size=TEXT_BYTES):
                for found in shingle_sets(batch.column(text_col).to_pylist()):
                    for band in set(bands_of(len(found))) & set(bands) if len(found) else ():
                        if only_thin and not thin_bands(found) >> band & 1:
                            continue
                        own = raw_signatures(found, band).view(np.int64)
                        yield _tables(schema, [[x] * len(own) for x in (node_of(found), len(found), -band)] + [own])

        return docs.select(text_col).mapInArrow(emit, "node long, n int, tag tinyint, sig long")

    held = settle(emitted(True).select("tag", "sig").distinct(), "thin")
    meeting = settle(emitted(False).join(held, ["tag", "sig"], "left_semi").dropDuplicates(["node", "tag", "sig"]), "meeting-thin")
    sizes = meeting.groupBy("tag", "sig").agg(F.count(F.lit(1)).cast("int").alias("g")).where("g > 1")
    return meeting.join(sizes, ["tag", "sig"]).select("node", "n", "tag", "sig", "g")


def candidate_groups(shared):
    """(sig, node, n): of each set with enough shared signatures, the rarest that must hold one common with any partner."""
    per_set = Window.partitionBy("node", "tag")
    wanted = F.expr(f"if(tag <> 0, greatest(1, int({SHARED} * shiftleft(1, int(abs(tag))))), 1)")
    # the rank first: its order serves the count too, so that rows are sorted once
    ranked = shared.withColumn("_rank", F.row_number().over(per_set.orderBy("g", "sig")))
    ranked = ranked.withColumn("_all", F.count(F.lit(1)).over(per_set))
    return ranked.where((F.col("_all") >= wanted) & (F.col("_rank") <= F.col("_all") - wanted + 1)).select("sig", "node", "n")


def _texts_of(docs, sets, nodes, id_col, text_col):
    """(node, text) for the wanted nodes, from one document of each."""
    picked = sets.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = settle(picked.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(), "candidate-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    found = named.join(ids, "_id", "left_semi").select("text").unionByName(named.where("_id is null").select("text"))

    def key(batches):
        schema = pa.schema([("node", pa.int64()), ("text", pa.string())])
        seen = set()
        for batch in pieces(batches, "text", size=TEXT_BYTES):
            texts = batch.column("text").to_pylist()
            rows = [(node_of(s), t) for s, t in zip(shingle_sets(texts), texts, strict=True) if len(s)]
            rows = [(k, t) for k, t in rows if not (k in seen or seen.add(k))]
            if rows:
                yield _tables(schema, zip(*rows, strict=True))

    keyed = found.mapInArrow(key, "node long, text string")
    return settle(keyed.dropDuplicates(["node"]), "candidate-texts")


def well_covered(texts, shingles):
    """(node, h): sets of which three quarters of the shingles, h of them, occur in other candidates too. ``shingles``: in all of them."""
    bits = _bits(shingles, 64, 8 * GROUP_ROWS)  # a set has a row in every group it touches
    blob = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
    hit = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("hits", pa.int32())])

    def emit(batches):
        for batch in pieces(batches, "text", size=TEXT_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist())
            node = np.array(batch.column("node").to_pylist(), dtype=np.int64)
            key, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            part = (key >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, owner, key = part[order], owner[order], key[order]
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            rows = []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                mine, counts = np.unique(owner[start:end], return_counts=True)
                low = np.ascontiguousarray(key[start:end]).view(np.uint8).reshape(-1, 8)[:, 2:]  # little endian: without the two lowest bytes
                rows.append((int(part[start]), node[mine].tobytes(), counts.astype(np.uint32).tobytes(), low.tobytes()))
            yield _tables(blob, zip(*rows, strict=True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slices(batches, 6, nodes=np.int64):
            order = np.argsort(held["keys"], kind="stable")
            node, key = held["nodes"][order], held["keys"][order]
            same = key[1:] == key[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            mine, at, n = np.unique(node, return_inverse=True, return_counts=True)
            yield _tables(hit, (mine, n.astype(np.int32), np.bincount(at, weights=shared, minlength=len(mine)).astype(np.int32)))

    found = texts.mapInArrow(emit, "part int, nodes binary, counts binary, keys binary").groupBy("part").applyInArrow(meet, "node long, n int, hits int")
    return found.groupBy("node").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where("4 * hits >= 3 * n").select("node", F.col("hits").alias("h"))


def distinct_groups(groups):
    """Groups of two or more members, one of all that have the same members (128 bits over the members tell)."""
    members = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("_g"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_m{k}") for k in (0, 1)])
    kept = members.where("_g > 1").groupBy("_g", "_m0", "_m1").agg(F.min("sig").alias("sig"))
    return groups.join(kept.select("sig"), "sig")


def rare_pairs(named, texts):
    """(a, b) of different components that share one of their rarest shingles; named: (node, n, label).

    A link takes three quarters of either set, so of a set's shingles in ascending order of frequency the first n - ceil(3n/4) + 1
    hold one of the link's. Those that only one component has can't be it; what is left of that beginning is the signature. Where two sets
    first meet, what follows in either must still suffice for a link: 3/7 of both sizes.
    """
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64())])

    def emit(batches):
        for batch in pieces(batches, "text", size=TEXT_BYTES):
            for node, keys in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text").to_pylist()), strict=True):
                yield _tables(schema, [np.full(len(keys), node, dtype=np.int64), keys.view(np.int64)])

    own = texts.join(named.select("node"), "node", "left_semi").mapInArrow(emit, "node long, key long")
    keyed = settle(own.join(named, "node"), "keyed")
    met = keyed.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("g")).where("_low < _high").select("key", "g")
    per_set = Window.partitionBy("node")
    ranked = keyed.join(met, "key").withColumns({"_hits": F.count(F.lit(1)).over(per_set), "_rank": F.row_number().over(per_set.orderBy("g", "key"))})
    rare = ranked.where("_rank <= _hits - ceil(3 * n / 4) + 1").select("key", "node", "n", "label", (F.col("_hits") - F.col("_rank") + 1).alias("rest"))
    rare = settle(rare, "rare")
    other = rare.withColumnsRenamed({c: f"{c}_b" for c in ("node", "n", "label", "rest")})
    both = rare.withColumnsRenamed({c: f"{c}_a" for c in ("node", "n", "label", "rest")}).join(other, "key")
    fits = "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b) and 7 * least(rest_a, rest_b) >= 3 * (n_a + n_b)"
    return both.where(f"node_a < node_b and label_a <> label_b and {fits}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def compared(pairs, texts, numerator=75, denominator=100):
    """(a, b, near, d): Jaccard distance of the pairs on whole texts, and whether they link.

    Nodes are dealt to blocks, and the pairs between two blocks are one group that gets each of its texts once: a node with
    many partners travels once per block and not once per pair. A block holds about BLOCK_CHARS of text.
    """
    pairs = settle(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    size = texts.join(ends, "node", "left_semi").agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS), math.ceil(math.sqrt(2 * pairs.count() / BLOCK_PAIRS)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias(f"block_{c}")
    dealt = pairs.select("a", "b", block("a"), block("b"))
    place = ["block_a", "block_b"]
    needed = dealt.select(*place, F.explode(F.array("a", "b")).alias("a")).distinct().join(texts.withColumnRenamed("node", "a"), "a")
    heads = needed.select(*place, "a", F.lit(None).cast("long").alias("b"), "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_()), ("d", pa.float64())])

    def compare(batches):
        group, held = None, {}
        for batch in pieces(batches, "text", size=TEXT_BYTES):
            rows, columns = [], [batch.column(c).to_pylist() for c in (*place, "a", "b")]
            sets = shingle_sets(batch.column("text").to_pylist())
            for block_a, block_b, left, right, own in zip(*columns, sets, strict=True):
                if (block_a, block_b) != group:
                    group, held = (block_a, block_b), {}
                if right is None:
                    held[left] = own
                    continue
                small, large = sorted((held[left], held[right]), key=len)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                union = len(small) + len(large) - both
                rows.append((left, right, denominator * both >= numerator * union, 1 - both / union))
            if rows:
                yield _tables(schema, zip(*rows, strict=True))

    lined = heads.unionByName(dealt.withColumn("text", F.lit(None).cast("string"))).repartition(*place)
    return lined.sortWithinPartitions(*place, F.col("b").asc_nulls_first()).mapInArrow(compare, "a long, b long, near boolean, d double")


def _open(groups, labels):
    """Groups with their members' components, where there are several."""
    named = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("sig")
    return named.join(several, "sig")


#: A pair may link: sizes fit, the shingles that occur elsewhere at all suffice for the intersection a link needs, 3/7 of
#: both sizes, and no common pivot tells its members apart. FAR is a quarter and a little for rounding.
_FIT = "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b) and 7 * least(h_a, h_b) >= 3 * (n_a + n_b)"
_FAR = "exists(zip_with(ds_a, ds_b, (x, y) -> abs(x - y) > 0.2500001D), far -> coalesce(far, false))"


def _pivots(left, turn):
    """One member of the largest component of each group, the one with the fewest shingles of its own: most others can then join at
    once. A member is taken again only when all others have been."""
    sizes = left.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("sig").agg(F.max_by("label", F.struct("_n", "label")).alias("label"))
    me = F.struct(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("h").alias("h_a"), F.col("label").alias("label_a"), F.col("ds").alias("ds_a"))
    central = F.struct(F.array_contains("ds", F.lit(0.0)), F.col("n") - F.col("h"), F.xxhash64("node", F.lit(turn)))
    return left.join(largest, ["sig", "label"]).groupBy("sig").agg(F.min_by(me, central).alias("_p")).select("sig", "_p.*")


def _joined(labels, links):
    """Labels after new links: only the components that the links touch are joined anew."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = settle(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
    of = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    merged = components(links.join(of("a"), "a").join(of("b"), "b").select("label_a", "label_b").distinct(), "label_a", "label_b")
    moved = known.join(merged.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left")
    return settle(moved.select("node", F.coalesce("_to", "label").alias("label")), "labels")


def node_components(docs, sets, id_col="doc_id", text_col="text", stars=STARS, most_stars=MOST_STARS):
    """(node, label): component label of every set with a partner."""
    spark = docs.sparkSession
    known = sets.agg(F.bit_or("thin").alias("thin"), F.sum("n_shingles").alias("shingles")).first()
    thin, shingles = known["thin"] or 0, known["shingles"] or 0
    shared = shared_signatures(docs, shingles, text_col)
    if thin:
        shared = shared.unionByName(thin_signatures(docs, [band for band in range(64) if thin >> band & 1], text_col))
    groups = settle(candidate_groups(shared), "groups")
    texts = _texts_of(docs, sets, groups.select("node").distinct(), id_col, text_col)
    groups = settle(distinct_groups(groups.join(settle(well_covered(texts, shingles), "covered"), "node")), "groups").withColumn("ds", F.array().cast("array<double>"))
    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))  # local rows would start Python workers of another kind on every executor
    done = None
    for turn in range(most_stars + 1):
        left = settle(_open(groups.select("sig", "node", "n", "h", "ds"), labels), "open")
        todo = left.count()
        if not todo:
            break
        star = turn < stars or turn < most_stars and todo < 0.75 * before
        before = todo
        if star:
            met = left.join(_pivots(left, turn), "sig").withColumnsRenamed({"node": "b", "n": "n_b", "h": "h_b", "ds": "ds_b", "label": "label_b"})
            pairs = met.where(f"label_a <> label_b and {_FIT} and not {_FAR}").select("a", "b")
        else:
            pairs = rare_pairs(left.select("node", "n", "label").distinct(), texts)
        pairs = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).dropDuplicates(["low", "high"])
        if done is not None:
            pairs = pairs.join(done, ["low", "high"], "left_anti")
        measured = settle(compared(pairs.select("a", "b"), texts), "measured")
        names = measured.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        done = names if done is None else done.unionByName(names)
        labels = _joined(labels, measured.where("near").select("a", "b"))
        if not star:
            break
        distance = measured.select("a", "b", "d")
        told = met.select("sig", "a", "b", "n_b", "h_b", "ds_b").join(distance, ["a", "b"], "left")
        groups = told.select("sig", F.col("b").alias("node"), F.col("n_b").alias("n"), F.col("h_b").alias("h"), F.concat("ds_b", F.array(F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("d")))).alias("ds"))
    return labels


def jaccard_components(docs, id_col="doc_id", text_col="text"):
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id of its component)."""
    sets = settle(document_sets(docs, id_col, text_col), "sets")
    labels = node_components(docs, sets, id_col, text_col)
    first = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    class_of = named.join(lowest, "label").select("node", "component_id")
    return sets.join(class_of, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs, id_col="doc_id", text_col="text"):
    """One row of each component: the one with its smallest id, the longest of several rows with that id.

    Every row is judged by its own text: of rows that share an id only those whose component has another row go. Rows without an id
    stay where no row of their component has one, one of each component. Rows without words all stay.
    """
    sets = settle(document_sets(docs, id_col, text_col), "sets")
    labels = node_components(docs, sets, id_col, text_col)
    named = sets.where("node is not null").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    crowds = named.groupBy("label").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")
    crowded = settle(named.join(crowds, "label"), "crowded")
    repeated = sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_again"))
    goes = crowded.where("doc_id <> keep_id").select("doc_id", F.lit(False).alias("_again"))
    changed = repeated.unionByName(goes).groupBy(F.col("doc_id").alias("_id")).agg(F.max("_again").alias("_again"))
    changed = settle(changed, "changed")
    near = F.broadcast(changed) if changed.count() <= BROADCAST_ROWS else changed
    rows = packed(docs, text_col).withColumn("_own", F.col(f"row.`{id_col}`").cast("long"))
    once = rows.where("_own is not null").join(near, F.col("_own") == F.col("_id"), "left_anti")
    again = rows.join(near.where("_again").select("_id"), F.col("_own") == F.col("_id"), "left_semi").unionByName(rows.where("_own is null"))
    judged = again.withColumn("_node", _fingerprint(F.col("text"))).join(crowded.select(F.col("node").alias("_node"), "label", "keep_id").distinct(), "_node", "left")
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.length("text").desc(), "text"))
    kept = judged.where("label is not null and _own <=> keep_id").withColumn("_once", first).where("_once = 1")
    kept = kept.unionByName(judged.where("label is null").withColumn("_once", F.lit(1)))
    return unpacked(once.select("row", "text").unionByName(kept.select("row", "text")), docs, text_col)
