"""Token counts by offset-mapped attribution.

A document is encoded once as a whole; the byte spans of its tokens are joined to the intervals of
its sections, and a token that crosses a boundary goes to one of them by an explicit rule:

- ``majority``: the section with most of its bytes, the earlier one of equals;
- ``first`` and ``last``: the section of its first or last byte.

Sections are the lines of a text, each with its line end. Every token belongs to one section, so
a document's section counts add up to its token count. Defined cases: null and empty texts have one empty
section without tokens; repeated rows are counted one by one; a text without line ends is one section.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the public pattern that splits text before the merges of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "first", "last")
_LOADED = {}


def encoder(path, pattern=PATTERN):
    """The encoding and the byte length of every token; loaded once in a worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _LOADED[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _LOADED[path, pattern]


def line_starts(data):
    """Byte starts of the sections of a text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.flatnonzero(raw[:-1] == 10) + 1 if len(raw) else np.empty(0, dtype=np.int64)
    return np.concatenate([[0], starts]).astype(np.int64)


def attribute(ends, starts, total, rule):
    """Tokens per section, and of them those that cross a boundary. ends: byte ends of the tokens; starts: of the sections."""
    begin = np.concatenate([[0], ends])[:-1]
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    owner = last.copy() if rule == "last" else first.copy()
    across = np.flatnonzero(first != last)
    if rule == "majority":
        bounds = np.append(starts, total)
        for i in across:
            held = range(first[i], last[i] + 1)
            owner[i] = max(held, key=lambda s, i=i: (min(ends[i], bounds[s + 1]) - max(begin[i], bounds[s]), -s))
    counts = np.bincount(owner, minlength=len(starts))
    return counts, np.bincount(owner[across], minlength=len(starts))


def section_tokens(docs, id_col="doc_id", text_col="text", rule="majority", vocabulary=VOCABULARY, pattern=PATTERN):
    """doc_id, section, start, stop (code points), n_tokens, n_crossing for every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def count(batches):
        encoding, lengths = encoder(vocabulary, pattern)
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                text = text or ""
                data = text.encode()
                ids = np.array(encoding.encode_ordinary(text), dtype=np.int64)
                starts = line_starts(data)
                n, crossing = attribute(np.cumsum(lengths[ids]), starts, len(data), rule)
                points = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
                bounds = points[np.append(starts, len(data))]
                held.append(([doc_id] * len(starts), np.arange(len(starts)), bounds[:-1], bounds[1:], n, crossing))
                size += len(starts)
                if size > 50_000:
                    yield _batch(held, schema)
                    held, size = [], 0
            if held:
                yield _batch(held, schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(count, "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long")


def _batch(held, schema):
    ids = [x for h in held for x in h[0]]
    rest = [np.concatenate([h[k] for h in held]) for k in range(1, 6)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(rest, list(schema)[1:], strict=True)]], schema=schema)
