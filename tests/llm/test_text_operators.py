"""Decontamination, repeats, Jaccard join and token counts against brute force on small tables."""

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from billwright.llm import decontamination, jaccard, repeats, tokens
from cases import document_frame, documents, near, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    return Counter((d, len(sets[i]), lowest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def family(n, edits, seed=5):
    base = prose(seed, 90)
    return [(1000 + i, near(base, i, edits)) for i in range(n)]


@pytest.mark.parametrize("rows", [documents(), family(40, 3), family(30, 6, 8) + family(5, 0, 9), [(i, prose(1, 40) + " " + prose(200 + i, 25)) for i in range(30)]])
def test_jaccard_components(spark, rows):
    got = jaccard.jaccard_components(document_frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_rare_shingles_keep_every_link(spark):
    """Every link between sets of different components meets in a rare shingle where enough follows; few others do."""
    rows = [near(prose(3, 90), i, 1 + i % 4) for i in range(80)] + [prose(3, 90)[: 200 + 5 * i] for i in range(30)] + [near(prose(4, 300), i, i % 9) for i in range(40)]
    sets = jaccard.shingle_sets(rows)
    texts = {jaccard.node_of(s): (t, s) for t, s in zip(rows, sets, strict=True)}
    named = spark.createDataFrame([(k, len(s), k if i % 5 else 7) for i, (k, (_, s)) in enumerate(texts.items())], "node long, n int, label long")
    label = {r["node"]: r["label"] for r in named.collect()}
    frame = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "node long, text string")
    got = {tuple(sorted(map(int, r))) for r in jaccard.rare_pairs(named, frame).collect()}
    close = lambda a, b: 4 * len(np.intersect1d(texts[a][1], texts[b][1])) >= 3 * len(np.union1d(texts[a][1], texts[b][1]))
    links = {tuple(sorted((a, b))) for a, b in combinations(texts, 2) if label[a] != label[b] and close(a, b)}
    assert links <= got and len(links) > 100 and all(label[a] != label[b] for a, b in got)


def test_pairs_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", 3000)
    rows = [near(prose(3, 60), i, i % 6) for i in range(40)]
    sets = {jaccard.node_of(s): (t, s) for t, s in zip(rows, jaccard.shingle_sets(rows), strict=True)}
    asked = list(combinations(sets, 2))
    texts = spark.createDataFrame([(k, t) for k, (t, _) in sets.items()], "node long, text string")
    got = {(r["a"], r["b"]): (r["near"], r["d"]) for r in jaccard.compared(spark.createDataFrame(asked, "a long, b long"), texts).collect()}
    for a, b in asked:
        both, union = len(np.intersect1d(sets[a][1], sets[b][1])), len(np.union1d(sets[a][1], sets[b][1]))
        assert got[a, b] == (100 * both >= 75 * union, 1 - both / union)
    assert len(got) == len(asked)


def brute_kept(rows):
    """Rows that stay: of each component the least id and there the longest text; rows without words."""
    sets, groups, kept = [shingles(t) for _, t in rows], {}, []
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    for i in range(len(rows)):
        if sets[i]:
            groups.setdefault(root(i), []).append(rows[i])
        else:
            kept.append(rows[i])
    return Counter(kept + [min(g, key=lambda r: (r[0] is None, r[0] or 0, -len(r[1]), r[1])) for g in groups.values()])


MIXED = [(1, prose(5, 80)), (2, prose(5, 80)), (2, prose(6, 80)), (3, prose(7, 80)), (3, near(prose(7, 80), 1, 2)), (None, prose(8, 80)), (None, near(prose(8, 80), 1, 1)), (None, prose(5, 80)), (None, prose(9, 30)), (4, ""), (4, ""), (4, prose(6, 80))]


@pytest.mark.parametrize("rows", [documents(), MIXED, family(30, 3)])
def test_deduplicate_keeps_one_of_each_component(spark, rows):
    docs = document_frame(spark, rows)
    out = jaccard.deduplicate(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == brute_kept(rows)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(document_frame(spark, [])).count() == 0
    assert jaccard.deduplicate(document_frame(spark, [])).count() == 0


def test_signature_guarantee():
    """Sets that just link share the promised number of signatures, in every band they share."""
    rng = np.random.default_rng(1)
    for n in (1, 3, 12, 16, 20, 24, 40, 63, 64, 90, 300, 1000):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 64, 3 * n + 5, dtype=np.uint64))
            rng.shuffle(pool)
            size = rng.integers(max(1, -(-3 * n // 4)), 4 * n // 3 + 1)
            both = -(-3 * (n + size) // 7)
            if both > min(n, size):
                continue
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[n - both : n], pool[n : n + size - both]]))
            shared = set(jaccard.bands_of(len(a))) & set(jaccard.bands_of(len(b)))
            assert any(len(set(jaccard.signatures(a, k)[1].tolist()) & set(jaccard.signatures(b, k)[1].tolist())) >= jaccard.needed(jaccard.signatures(a, k)[0]) for k in shared)


@pytest.mark.parametrize(("small", "large"), [(23, 30), (21, 28), (22, 28), (24, 32), (45, 58), (46, 61), (47, 62), (95, 126)])
def test_no_short_pair_is_lost(small, large):
    """Subsets with a similarity of 3/4 or more share enough signatures of the same form."""
    rng = np.random.default_rng(small)
    for _ in range(10_000):
        whole = np.unique(rng.integers(0, 1 << 64, large, dtype=np.uint64))
        part = np.sort(rng.permutation(whole)[:small])
        shared = set(jaccard.bands_of(small)) & set(jaccard.bands_of(large))
        found = [(jaccard.signatures(part, k), jaccard.signatures(whole, k)) for k in shared]
        assert any(a[0] == b[0] and len(np.intersect1d(a[1], b[1])) >= jaccard.needed(a[0]) for a, b in found)


def thin_text(n, parts, band=7, seed=3):
    """Words whose n shingles lie in the first partitions of a band."""
    r = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(4)]
    while len(words) < n + 4:
        tried = [f"t{r.integers(10**6)}" for _ in range(60)]
        keys = [jaccard.shingle_sets([" ".join([*words[-4:], w])])[0] for w in tried]
        words.append(next(w for w, k in zip(tried, keys, strict=True) if jaccard._parted(k, band)[0][0] < parts))
    return " ".join(words)


def test_thin_sets_meet_the_others(spark):
    """A set with too few non-empty partitions links with one that has enough."""
    text = thin_text(200, 78)
    words = text.split()
    for at in (40, 100, 160):
        words[at] = f"y{at}"
    thin, other = jaccard.shingle_sets([text, " ".join(words)])
    assert jaccard.signatures(thin, 7)[0] == -7 and jaccard.signatures(other, 7)[0] == 7
    rows = [(1, text), (2, " ".join(words)), (3, text), (4, prose(9, 204)), (None, None)]
    got = jaccard.jaccard_components(document_frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def brute_repeats(rows, depth):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = Counter()
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = 1
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out[doc_id, len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("depth", [200, 40])
def test_repeats(spark, depth):
    rows = documents() + [(50, prose(0, 60) + prose(51, 60)), (51, "ab" * 300), (52, prose(53, 50) + "ab" * 200), (53, prose(0, 120)[200:500])]
    got = repeats.remove_repeats(document_frame(spark, rows), depth=depth).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows, depth)


def test_repeats_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    assert {n for n, _ in repeats._windows_in_blocks(b"x" * 300, 200)} == {0, 64}
    assert repeats.remove_repeats(document_frame(spark, [])).count() == 0


def items(spark):
    return spark.createDataFrame([(1, prose(0, 120)[:90]), (2, "One, two!"), (3, None), (4, "--"), (None, prose(15, 4000)[100:200]), (5, prose(77, 30))], "item_id long, text string")


def brute_hits(rows, tests, window=10):
    out = Counter()
    for doc_id, text in rows:
        w, hit, named = decontamination.words(text), set(), set()
        for item, t in tests:
            own = decontamination.words(t)
            n = min(window, len(own))
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    named.add("" if item is None else str(item))
        out[doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [200_000, 15])
def test_hits_in_one_and_several_blocks(spark, block):
    bench = items(spark)
    got = decontamination.hit_report(document_frame(spark), bench, block_windows=block).collect()
    assert Counter(tuple(r) for r in got) == brute_hits(documents(), [tuple(r) for r in bench.collect()])


def test_decontaminate_documents_and_spans(spark):
    docs, bench = document_frame(spark), items(spark)
    hits = brute_hits(documents(), [tuple(r) for r in bench.collect()])
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in hits.items() if not k[-1])
    cut = decontamination.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[9] == "" and texts[11] == "solo" and texts[6] is None
    assert decontamination.hit_report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.hit_report(document_frame(spark, []), bench).count() == 0


def test_section_tokens(spark):
    text = "First line here.\nsecond  line\n\nlast"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "no end"), (None, "é😀\nü"), (5, "x" * 5000)]
    for rule in tokens.RULES:
        got = tokens.section_tokens(document_frame(spark, rows), rule=rule).collect()
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r)
        encoding, _ = tokens.encoder(tokens.VOCABULARY)
        for doc_id, t in rows:
            n = len(encoding.encode_ordinary(t or "")) * sum(d == doc_id for d, _ in rows)
            assert sum(r["n_tokens"] for r in by[doc_id]) == n
        assert [(r["start"], r["stop"]) for r in sorted(by[None], key=lambda r: r["section"])] == [(0, 3), (3, 4)]
        assert len(by[2]) == len(by[3]) == len(by[4]) == 1
    assert tokens.section_tokens(document_frame(spark, [])).count() == 0


def test_boundary_rules():
    ends, starts = np.array([2, 7, 9]), np.array([0, 4, 6])
    assert tokens.attribute(ends, starts, 9, "first")[0].tolist() == [2, 0, 1]
    assert tokens.attribute(ends, starts, 9, "last")[0].tolist() == [1, 0, 2]
    assert tokens.attribute(ends, starts, 9, "majority")[0].tolist() == [2, 0, 1]


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """Two thousand texts of 20 kB would travel to a worker as one batch of 40 MB."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from billwright.llm import decontamination, ftrl, jaccard

    docs = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 2500).alias("text"))
    benchmark = spark.createDataFrame([("1", "none of it")], "item_id string, text string")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    for step in (lambda: decontamination.scan(docs, benchmark), lambda: jaccard.document_sets(docs), lambda: ftrl.score(docs, [0.0], ftrl.word_features)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        step()
        found = docs.mapInArrow(sizes, "n long, size long").agg(F.sum("n").alias("n"), F.max("size").alias("size")).first()
        assert found["n"] == 2000 and found["size"] < 6 << 20


def test_words_are_held_for_a_slice_of_the_texts():
    """Words as objects take ten times their text: 4 MB of text at once took more than 40 MB."""
    import tracemalloc

    texts = [" ".join(f"{i}x{j}" for j in range(250)) for i in range(2000)] + [None, "", "one two"]
    whole = jaccard._shingle_sets(texts)
    tracemalloc.start()
    found = jaccard.shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(found, whole, strict=True)) and peak < 30 << 20
    assert jaccard.shingle_sets([]) == []


@pytest.mark.parametrize("width", [5, 6])
def test_groups_are_sorted_by_slices(width):
    """A group of a million keys comes in slices of about SORT_ROWS, each key with its set, equal keys in one slice."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    batches, expected = [], []
    for b in range(4):
        rows = []
        for _ in range(5):
            counts = rng.integers(1, 100, 1000).astype(np.uint32)
            nodes, key = rng.integers(0, 1 << 60, 1000), rng.integers(0, 1 << 8 * width, counts.sum()) % (200_000 if b else 1 << 8 * width)
            low = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :width]
            rows.append((9, nodes.tobytes(), counts.tobytes(), (key % 7).astype(np.int8).tobytes(), low.tobytes()))
            expected.append(np.stack([key, np.repeat(nodes, counts), key % 7]))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "nodes", "counts", "tags", "keys"]))
    got = list(jaccard._slices(iter(batches), width, nodes=np.int64, tags=np.int8))
    assert max(len(x["keys"]) for x in got) < 1.2 * jaccard.SORT_ROWS and {x["part"] for x in got} == {9}
    assert sum(len(np.unique(x["keys"])) for x in got) == len(np.unique(np.concatenate([x["keys"] for x in got])))
    found, expected = np.concatenate([np.stack([x["keys"], x["nodes"], x["tags"]]) for x in got], axis=1), np.concatenate(expected, axis=1)
    assert np.array_equal(found[:, np.lexsort(found)], expected[:, np.lexsort(expected)])


def test_jaccard_join_holds_little(spark, monkeypatch):
    """Candidates are sorted once, and no local rows pass through Python workers of their own."""
    from pyspark.sql import functions as F

    shared = spark.range(1000).select(F.expr("id % 50").alias("node"), F.lit(20).alias("n"), F.lit(4).cast("tinyint").alias("tag"), (F.col("id") % 97).alias("sig"), (F.col("id") % 5).cast("int").alias("g"))
    plan = jaccard.candidate_groups(shared)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 2
    docs = document_frame(spark, [(1, prose(1, 90)), (2, prose(1, 90)), (3, prose(7, 90))])
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert sorted(r["doc_id"] for r in jaccard.deduplicate(docs).collect()) == [1, 3]
