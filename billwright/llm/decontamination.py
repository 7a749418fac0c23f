"""Benchmark decontamination: training texts against the word windows of test items.

Windows of the test items form a hash set that is broadcast in blocks of bounded size; every
document is scanned with rolling window keys, key hits are verified word by word, and the hit words
are counted, cut out, or cost the document.

Defined cases: null and empty texts have no words and no hits; an item without words has no
window; an item without an id marks words but is listed as the empty string; repeated document
rows are judged one by one; an empty benchmark leaves every document clean.
"""

import re

import numpy as np
from pyspark.sql import functions as F

from billwright.llm.arrow import bounded_batches, packed, replaced, unpacked

WINDOW = 10
#: Windows of one broadcast block; larger benchmarks are scanned block after block.
BLOCK_WINDOWS = 200_000
_FOLD = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text):
    """Words of a text as bytes, A-Z lower-cased; every other character under 128 that is no digit or letter parts them."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """Windows of a block of items: word numbers, sorted keys per window length, and the exact windows."""

    def __init__(self):
        self.vocabulary, self.exact, self.keys, self.items = {}, {}, {}, 0

    def add(self, item, text, window):
        found = words(text)
        if not found:
            return
        ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found)
        length = min(window, len(ids))
        for i in range(len(ids) - length + 1):
            self.exact.setdefault(ids[i : i + length], set()).add(item)

    def seal(self):
        by_length = {}
        for gram in self.exact:
            by_length.setdefault(len(gram), []).append(gram)
        for length, grams in by_length.items():
            self.keys[length] = np.unique(_rolling(np.array(grams, dtype=np.uint64).T))
        return self

    def hits(self, found):
        """Hit mask over the words of one text, and the ids of the items with occurring windows."""
        mask, items = np.zeros(len(found), dtype=bool), set()
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in found), dtype=np.uint64, count=len(found))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, keys in self.keys.items():
            starts = np.flatnonzero(unknown[length:] == unknown[:-length]) if len(ids) >= length else ()
            if not len(starts):
                continue
            key = _rolling([ids[starts + j] for j in range(length)])
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            for start in starts[keys[at] == key]:
                named = self.exact.get(tuple(ids[start : start + length].tolist()))
                if named:
                    mask[start : start + length] = True
                    items |= named
        return mask, items


def _rolling(columns):
    key = np.zeros_like(np.asarray(columns[0], dtype=np.uint64))
    for column in columns:
        key = key * _BASE + column
    return key


def blocks(benchmark, id_col="item_id", text_col="text", window=WINDOW, block_windows=BLOCK_WINDOWS):
    """Sealed blocks of windows; the driver holds one block at a time."""
    block, any_block = Windows(), False
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        block.add(item, text, window)
        if len(block.exact) >= block_windows:
            yield block.seal()
            block, any_block = Windows(), True
    if block.exact or not any_block:
        yield block.seal()


def scan(docs, benchmark, text_col="text", window=WINDOW, block_windows=BLOCK_WINDOWS, item_id="item_id", item_text="text"):
    """docs with n_words, n_hit, hit_items (ids as text) and hit_bits (packed mask over the words); docs has none of these."""
    spark = docs.sparkSession
    bounded_batches(spark)
    added = ["n_words", "n_hit", "hit_items", "hit_bits"]
    out = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
        "hit_items": F.array().cast("array<string>"), "hit_bits": F.lit(None).cast("binary"),
    })
    schema = out.schema
    for block in blocks(benchmark, item_id, item_text, window, block_windows):
        shared = spark.sparkContext.broadcast(block)

        def mark(batches, shared=shared):
            block = shared.value
            for batch in batches:
                rows = []
                for text, items, bits in zip(*(batch.column(c).to_pylist() for c in (text_col, "hit_items", "hit_bits")), strict=True):
                    found = words(text)
                    mask, named = block.hits(found)
                    if bits is not None:
                        mask |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(found)).astype(bool)
                    n = int(mask.sum())
                    rows.append((len(found), n, sorted(named | set(items)), np.packbits(mask).tobytes() if n else None))
                yield replaced(batch, **dict(zip(added, zip(*rows, strict=True), strict=True)) if rows else {})

        out = out.mapInArrow(mark, schema)
    return out


def hit_report(docs, benchmark, **options):
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = scan(docs.select("doc_id", "text"), benchmark, **options)
    listed = F.array_sort("hit_items")
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs, benchmark, remove="documents", text_col="text", **options):
    """Documents without test passages: ``documents`` drops those with a hit, ``spans`` cuts the hit words out of them."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    marked = scan(packed(docs, text_col), benchmark, **options)
    if remove == "documents":
        return unpacked(marked.where("n_hit = 0"), docs, text_col)

    def cut(batches):
        for batch in batches:
            texts, bits = batch.column("text").to_pylist(), batch.column("hit_bits").to_pylist()
            yield replaced(batch, text=[_without(t, b) for t, b in zip(texts, bits, strict=True)])

    return unpacked(marked.mapInArrow(cut, marked.schema), docs, text_col)


def _without(text, bits):
    """The text without its hit words and what stands between two neighbouring ones."""
    if bits is None:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    mask = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(spans))
    kept, start = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
    for first, end in edges.reshape(-1, 2):
        kept.append(text[start : spans[first][0]])
        start = spans[end - 1][1]
    return "".join(kept) + text[start:]
