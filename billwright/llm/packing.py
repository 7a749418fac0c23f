"""Packing of documents into sequences by length patterns fitted with non-negative least squares.

Documents become token ids closed by one id; longer ones are cut into full sequences behind a first piece that
may be shorter. Only the histogram of piece lengths (one count per length up to the sequence size) reaches the driver:

1. all patterns of up to ``DEPTH`` lengths that fill a sequence exactly are enumerated over the lengths that occur;
2. repeat counts x >= 0 that bring the patterns' lengths close to the histogram are fitted by non-negative least squares
   (multiplicative updates, which keep x non-negative);
3. counts are rounded down, never beyond what is left of a length: a residual with every length in it packs best;
4. the residual pieces are packed by best fit, longest first, on the histogram again: equal sequences are handled as one
   class with a count, so the work depends on the number of lengths and not on the number of pieces.

The plan, at most a few slots per length, is a table (length, first rank, sequence, offset). Pieces are ranked inside their
length over hashed blocks of bounded size, so a length that most pieces have is spread over many tasks, and look their place up.

Defined cases: a null text is an empty one, and an empty document is the closing id alone; repeated rows are
packed each for itself; rows without an id are packed like others; an empty table has no pieces.
"""

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright.llm.arrow import pieces as text_pieces
from billwright.operators.settle import settle as write

SIZE = 2048
CLOSE = 0
DEPTH = 3
UPDATES = 60
#: Patterns in a plan: those with the greatest counts. The residual packing takes all the rest, so this bounds the plan, not the pieces.
PATTERNS = 20_000
#: Share of every length that the residual keeps, so that it has short pieces to close gaps with.
RESERVE = 0.1
#: Pieces of one length that one window group numbers.
BLOCK_ROWS = 50_000
# fixed value: the only special token of the vocabulary, an ordinary id wherever a text holds its string
SPECIAL = {"<|endoftext|>": 50256}
_LOADED = {}


def encoder(vocabulary=None):
    """The byte-level vocabulary from its rank file; by default the installed one. Gives the ids of its JSON form."""
    if vocabulary not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _LOADED[vocabulary]


def cuts(n, size):
    """Starts of the pieces of a document of n ids: only the first can be shorter than the size, if there are several."""
    if n <= size:
        return [0]
    first = (n - 1) % size + 1
    return [0, *range(first, n, size)]


def document_pieces(docs, id_col="doc_id", text_col="text", size=SIZE, close=CLOSE, vocabulary=None, with_ids=False):
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + ([pa.list_(pa.int32())] if with_ids else [])
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches):
        encoding = encoder(vocabulary)
        for batch in text_pieces(batches, text_col, size=4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                text = text or ""
                own = encoding.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else encoding.encode_ordinary(text)
                own = np.array([*own, close], dtype="<u4")
                starts = cuts(len(own), size)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):
                    row = (doc_id, k, a, b - a, zlib.crc32(own[a:b].tobytes()))
                    rows.append((*row, own[a:b].tolist()) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(cut, fields)


def full_patterns(lengths, size=SIZE, depth=DEPTH):
    """Rows of ``depth`` lengths, longest first and 0 for none, that add up to the size; made of the given lengths only."""
    have = np.zeros(size + 1, dtype=bool)
    have[lengths] = True
    rows = np.array([[size]], dtype=np.int64) if have[size] else np.empty((0, 1), dtype=np.int64)
    found = [np.pad(rows, ((0, 0), (0, depth - 1)))]
    short = np.array(sorted(x for x in lengths if x < size), dtype=np.int64)[::-1]
    heads = short[:, None]
    for width in range(2, depth + 1):
        left = size - heads.sum(axis=1)
        closes = (left > 0) & (left <= heads[:, -1])
        closes[closes] = have[left[closes]]
        found.append(np.pad(np.column_stack([heads[closes], left[closes]]), ((0, 0), (0, depth - width))))
        if width < depth:
            nexts = [(h, short[(short <= h[-1]) & (short < size - h.sum())]) for h in heads]
            heads = np.concatenate([np.column_stack([np.tile(h, (len(x), 1)), x]) for h, x in nexts]) if nexts else heads[:0]
            if not len(heads):
                break
    return np.concatenate(found)


def repeat_counts(patterns, histogram, updates=UPDATES):
    """x >= 0 that minimises |A x - h|², where A counts each length in each pattern."""
    used = histogram.astype(np.float64)
    slots = patterns.ravel()
    real = patterns > 0

    def spread(per_length):
        return np.where(real, per_length[patterns], 0).sum(axis=1)

    wanted = spread(used)
    x = np.where(real, used[patterns], np.inf).min(axis=1) / np.maximum(1, np.bincount(slots, minlength=len(used))[patterns[:, 0]])
    for _ in range(updates):
        held = np.bincount(slots, weights=np.repeat(x, patterns.shape[1]), minlength=len(used))
        held[0] = 0
        x = x * wanted / np.maximum(spread(held), 1e-12)
    return x


def rounded(patterns, x, histogram, most=PATTERNS, reserve=RESERVE):
    """(lengths, count) of the patterns used, and what is left of the histogram."""
    kept = np.ceil(histogram * reserve).astype(np.int64)
    kept[-1] = 0  # full pieces close no gap
    left, plan = histogram - kept, []
    for k in np.argsort(-x, kind="stable")[:most].tolist():
        row = [v for v in patterns[k].tolist() if v]
        if x[k] < 1:
            break
        count = min(int(x[k]), *(int(left[v]) // row.count(v) for v in row))
        if count > 0:
            plan.append((tuple(row), count))
            for v in row:
                left[v] -= count
    return plan, left + kept


def best_fit(histogram, size=SIZE):
    """(lengths, count) of a best-fit packing of the histogram, longest pieces first."""
    bins = [[] for _ in range(size + 1)]  # classes (lengths, count) by free space

    def put(row, count, length, copies):
        if count:
            bins[size - sum(row) - length * copies].append((row + (length,) * copies, count))

    for length in range(size, 0, -1):
        todo = int(histogram[length])
        space = length
        while todo and space <= size:
            if not bins[space]:
                space += 1
                continue
            row, count = bins[space].pop()
            copies = space // length
            whole = min(count, todo // copies)
            rest = min(todo - whole * copies, copies) if whole < count else 0
            put(row, whole, length, copies)
            if rest:
                put(row, 1, length, rest)
            untouched = count - whole - (1 if rest else 0)
            if untouched:
                bins[space].append((row, untouched))
            todo -= whole * copies + rest
        copies = size // length
        put((), todo // copies, length, copies)
        if todo % copies:
            put((), 1, length, todo % copies)
    return [one for classes in bins for one in classes]


def packing_plan(histogram, size=SIZE, depth=DEPTH, updates=UPDATES):
    """Lengths and number of equal sequences. histogram[k]: pieces of length k."""
    lengths = np.flatnonzero(histogram)
    patterns = full_patterns(lengths.tolist(), size, depth)
    plan, left = rounded(patterns, repeat_counts(patterns, histogram, updates), histogram) if len(patterns) else ([], histogram)
    return plan + best_fit(left, size)


def slots(plan):
    """The plan as arrays sorted by (length, first rank): length, first, sequence and offset of that rank."""
    taken, rows, sequence = {}, [], 0
    for lengths, count in plan:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(pieces, rows):
    """Pieces with their rank inside their length, counted from 0 over hashed blocks of bounded size."""
    blocks = max(1, math.ceil(rows / BLOCK_ROWS))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    totals = dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_total"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).select("length", "_block", "_before")
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    return dealt.withColumn("_in", F.row_number().over(inside)).join(offsets, ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_block", "_in", "_before")


def placed(pieces, settle=write, size=SIZE, depth=DEPTH, updates=UPDATES):
    """Pieces with sequence_id and offset. ``pieces`` needs doc_id, piece and length; it is read twice, so written first."""
    pieces = settle(pieces, "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per length
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in counts:
        histogram[row["length"]] = row["n"]
    plan = slots(packing_plan(histogram, size, depth, updates))
    wide = 1 << 40
    keys = plan[:, 0] * wide + plan[:, 1]
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def look_up(batches):
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * wide + rank, side="right") - 1
            own = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_rank"]
            found = [pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])]
            yield pa.RecordBatch.from_arrays(own + found, names=[n for n in batch.schema.names if n != "_rank"] + schema.names)

    lined = ranked(pieces, int(histogram.sum()))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return lined.select(*pieces.columns, "_rank").mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def pack(docs, id_col="doc_id", text_col="text", settle=write, size=SIZE, close=CLOSE, vocabulary=None, with_ids=False, depth=DEPTH):
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset for every piece of every document."""
    return placed(document_pieces(docs, id_col, text_col, size, close, vocabulary, with_ids), settle, size, depth)


def sequences(packed):
    """The packed sequences: sequence_id, ids and the documents in them, from pieces with ids. A sequence is at most ``size`` ids long."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return rows.select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.transform("_parts", lambda p: p.dropFields("ids")).alias("documents"))
