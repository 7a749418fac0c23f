"""Periodic runs of words by suffix-tree LCE.

A run is a maximal stretch of words with smallest period q whose length is at least ``power`` periods and
``least`` words. By the runs theorem the longest Lyndon word that starts at some position, in the order of the words
or in its reverse, is a root of every run. A document therefore gets the Ukkonen tree of its words and the one of their
reversal; the order of the leaves of the first tree tells where the next smaller suffix begins, which ends the Lyndon
word; Euler tours over both trees with constant-time range minima (lowest common ancestors) extend every root to
the right and to the left.

Before trees are built, words that can't lie in a run split the document: inside a run every word occurs ``power``
times and every pair of neighbours ``power - 1`` times. Stretches that pass this count hold all runs, so
only they get trees; a document of ordinary prose has none. The counts are repeated a few times, or fewer where
nothing changes; stopping early only leaves more for the trees.

Documents don't depend on each other: there is no shuffle, and a task holds the words of a bounded piece of a
batch (one long document aside). Defined cases: null, empty and blank texts have no words and no runs; repeated rows
are answered one by one; rows without an id are never rebuilt; other columns are not read.
"""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from billwright.llm.arrow import pieces

LEAST, POWER = 6, 4
#: Rounds of counting that split documents before trees are built.
ROUNDS = 8
_BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of codes >= 1, closed by the code 0, with Euler tour and range minima."""

    def __init__(self, codes):
        text = [*codes, 0]
        self.size = len(text)
        self.starts, self.stops, self.kids = _ukkonen(text)

    def tour(self, last=False):
        """Order of the suffixes, the end of the text before all words (or behind them); keeps the Euler tour."""
        n, starts, stops, kids = self.size, self.starts, self.stops, self.kids
        order, depths, place = [], [], [0] * n
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back at an inner node between two children
                depths.append(depth)
                continue
            below = kids[node]
            if below is None:
                suffix = n - depth
                place[suffix] = len(depths)
                order.append(suffix)
                depths.append(depth)
                continue
            depths.append(depth)
            codes = sorted(below, reverse=True)
            if last and codes[-1] == 0:
                codes = [0, *codes[:-1]]
            for code in codes:
                child = below[code]
                stack.append((-1, depth))
                stack.append((child, depth + stops[child] - starts[child]))
        self._minima(np.array(depths, dtype=np.int32), np.array(place, dtype=np.int64))
        return np.array(order, dtype=np.int64)

    def _minima(self, depths, place):
        """Constant-time minima over the tour: inside a block from both ends, over whole blocks by a sparse table."""
        blocks = -(-len(depths) // _BLOCK)
        square = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        square[: len(depths)] = depths
        square = square.reshape(blocks, _BLOCK)
        self.place, self.flat = place, square.ravel()
        self.from_left = np.minimum.accumulate(square, axis=1).ravel()
        self.from_right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [square.min(axis=1)]
        while 1 << len(self.table) <= blocks:
            row, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(row[:-half], row[half:]))

    def lce(self, i, j):
        """Length of the common beginning of the suffixes at i and at j, which differ."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, final = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.from_right[a], self.from_left[b])
        near = np.flatnonzero(first == final)
        if len(near):  # both in one block: at most _BLOCK steps
            left, right = a[near], b[near]
            low = self.flat[left]
            for step in range(1, _BLOCK):
                low = np.minimum(low, self.flat[np.minimum(left + step, right)])
            out[near] = low
        wide = np.flatnonzero(final - first > 1)
        if len(wide):
            low, high = first[wide] + 1, final[wide]
            level = np.log2(high - low).astype(np.int64)
            for k in np.unique(level):
                at = level == k
                row = self.table[k]
                out[wide[at]] = np.minimum(out[wide[at]], np.minimum(row[low[at]], row[high[at] - (1 << int(k))]))
        return out.astype(np.int64)


def _ukkonen(text):
    """Edge labels text[start:stop] per node, and the children of inner nodes; the tree grows online."""
    n = len(text)
    starts, stops, links, kids = [0], [0], [0], [{}]
    node, edge, length, open_suffixes = 0, 0, 0, 0
    for i, code in enumerate(text):
        open_suffixes += 1
        unlinked = 0
        while open_suffixes:
            if length == 0:
                edge = i
            below = kids[node]
            child = below.get(text[edge])
            if child is None:
                below[text[edge]] = len(starts)
                starts.append(i)
                stops.append(n)
                links.append(0)
                kids.append(None)
                if unlinked:
                    links[unlinked] = node
                    unlinked = 0
            else:
                begin = starts[child]
                span = min(stops[child], i + 1) - begin
                if length >= span:
                    node, length, edge = child, length - span, edge + span
                    continue
                if text[begin + length] == code:
                    length += 1
                    if unlinked:
                        links[unlinked] = node
                    break
                inner = len(starts)
                below[text[edge]] = inner
                starts += [begin, i]
                stops += [begin + length, n]
                links += [0, 0]
                kids += [{text[begin + length]: child, code: inner + 1}, None]
                starts[child] = begin + length
                if unlinked:
                    links[unlinked] = inner
                unlinked = inner
            open_suffixes -= 1
            if node == 0 and length:
                length -= 1
                edge = i - open_suffixes + 1
            elif node:
                node = links[node]
    return starts, stops, kids


def _next_smaller(order):
    """For every suffix the next later one that comes before it in the order."""
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    rank, out, stack = rank.tolist(), [0] * len(order), []
    for i in range(len(rank) - 1, -1, -1):
        own = rank[i]
        while stack and rank[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] if stack else len(rank) - 1
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(codes, least=LEAST, power=POWER):
    """(start, length, period) of all runs of a sequence of codes >= 1, by start and period."""
    n = len(codes)
    if n < max(least, power):
        return np.empty((0, 3), dtype=np.int64)
    codes = np.asarray(codes).tolist()
    ahead, back = SuffixTree(codes), SuffixTree(codes[::-1])
    back.tour()
    orders = [ahead.tour(), ahead.tour(last=True)[::-1]]
    at = np.arange(n)
    i = np.concatenate([at, at])
    period = np.concatenate([_next_smaller(o)[:n] for o in orders]) - i
    fits = period * power <= n
    i, period = i[fits], period[fits]
    right = ahead.lce(i, i + period)
    left = back.lce(n - i, n - i - period)
    found = np.stack([i - left, left + period + right, period], axis=1)
    found = found[(found[:, 1] >= least) & (found[:, 1] >= power * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(codes, edges, least=LEAST, power=POWER, rounds=ROUNDS):
    """(start, stop) of the parts of documents that can hold runs. codes: words of many documents, one behind the other;
    edges: where documents begin, and the end."""
    at = np.arange(len(codes))
    part = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    kinds = int(codes.max()) + 1 if len(codes) else 1
    for _ in range(rounds):
        if not len(at):
            break
        was = len(at)
        word = pd.factorize(part * kinds + codes[at])[0]
        keep = np.bincount(word)[word] >= power
        at, part = at[keep], part[keep]
        joined = (at[1:] == at[:-1] + 1) & (part[1:] == part[:-1])
        pair = pd.factorize((part[:-1] * kinds + codes[at[:-1]])[joined])[0].astype(np.int64)
        pair = pd.factorize(pair * kinds + codes[at[1:]][joined])[0]
        joined[joined] = np.bincount(pair)[pair] >= power - 1 if len(pair) else False
        part = np.concatenate([[0], np.cumsum(~joined)]) if len(at) else part
        keep = np.bincount(part)[part] >= max(least, power) if len(at) else np.empty(0, dtype=bool)
        at, part = at[keep], part[keep]
        if len(at) == was:
            break
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(at) else np.empty(0, dtype=np.int64)
    ends = np.concatenate([cuts[1:], [len(at)]]) if len(at) else cuts
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(cuts, ends, strict=True)]


def repeated_places(doc_id, n):
    """Which word stands at each place of a document of n words: every tenth document repeats its end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def document_runs(ids, texts, least=LEAST, power=POWER, places=None):
    """Per document (words, runs); ``places(doc_id, n)`` may name another word for every place."""
    words = [(t or "").encode().split() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = np.empty(edges[-1], dtype=object)
    flat[:] = [w for ws in words for w in ws]
    codes = pd.factorize(flat)[0] + 1 if len(flat) else np.empty(0, dtype=np.int64)
    for k, doc_id in enumerate(ids):
        moved = places(doc_id, len(words[k])) if places else None
        if moved is not None:
            codes[edges[k] : edges[k + 1]] = codes[edges[k] + moved]
            words[k] = [words[k][j] for j in moved.tolist()]
    found = [[] for _ in words]
    for start, stop in stretches(codes, edges, least, power):
        own = runs_of(codes[start:stop], least, power)
        if len(own):
            k = int(np.searchsorted(edges, start, side="right")) - 1
            own[:, 0] += start - edges[k]
            found[k].append(own)
    none = np.empty((0, 3), dtype=np.int64)
    return [(w, np.unique(np.concatenate(f)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if f else none) for w, f in zip(words, found, strict=True)]


def strongest(runs):
    """The run with the greatest length/period; ties go to the smaller start, then period."""
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()
    best = near[0]
    for run in near[1:]:  # sorted by start and period: only a greater exponent replaces
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words, runs):
    """The words without those that a run holds behind its first period."""
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


_FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs, id_col="doc_id", text_col="text", least=LEAST, power=POWER, places=None):
    """Per document the number of runs, its strongest run, and digests of all runs and of the collapsed text."""

    def report(batches):
        for batch in pieces(batches, text_col, size=4 << 20):
            ids, rows = batch.column(id_col).to_pylist(), []
            for doc_id, (words, runs) in zip(ids, document_runs(ids, batch.column(text_col).to_pylist(), least, power, places), strict=True):
                start, length, period = strongest(runs) if len(runs) else (None, None, None)
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
                kept = b" ".join(collapsed(words, runs))
                rows.append((doc_id, len(runs), start, length, period, 1000 * length // period if period else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(report, _FIELDS)


def runs(docs, id_col="doc_id", text_col="text", least=LEAST, power=POWER):
    """One row per run: doc_id, start (word number), length, period, and the words of its first period."""

    def emit(batches):
        for batch in pieces(batches, text_col, size=4 << 20):
            ids, rows = batch.column(id_col).to_pylist(), []
            for doc_id, (words, found) in zip(ids, document_runs(ids, batch.column(text_col).to_pylist(), least, power), strict=True):
                rows += [(doc_id, a, b, c, b" ".join(words[a : a + c]).decode()) for a, b, c in found.tolist()]
            if rows:
                types = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "length", "period", "root"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(emit, "doc_id long, start long, length long, period long, root string")


def collapse(docs, id_col="doc_id", text_col="text", least=LEAST, power=POWER):
    """The documents with every run cut to its first period; words are then joined by one space. Texts without runs stay as they are."""

    def cut(batches):
        for batch in pieces(batches, text_col, size=4 << 20):
            texts = batch.column(text_col).to_pylist()
            found = document_runs([None] * len(texts), texts, least, power)
            changed = [b" ".join(collapsed(words, own)).decode() if len(own) else t for t, (words, own) in zip(texts, found, strict=True)]
            at = batch.schema.get_field_index(text_col)
            arrays = list(batch.columns)
            arrays[at] = pa.array(changed, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)
