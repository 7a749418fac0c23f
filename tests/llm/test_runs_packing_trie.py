"""Periodic runs, packing and the conversation trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from billwright.llm import packing, periodic, trie
from billwright.llm.queries import op13
from cases import document_frame, documents, prose


def brute_runs(w, least=6, power=4):
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, power * q):
                s = w[i : i + length]
                if all(s[p:] != s[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text, rebuild):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if rebuild and doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive():
    r, rows = random.Random(4), []
    for i in range(400):
        words = [f"w{r.randrange(r.choice([1, 2, 3, 40]))}" for _ in range(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 3)):
            unit = [f"v{r.randrange(3)}" for _ in range(r.randrange(1, 9))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (unit * 12)[: r.randrange(1, 80)]
        rows.append((i, r.choice([" ", "\n", " \t\x0b\x1c "]).join(words)))
    rows += [(900, "a " * 5), (901, "a " * 6), (902, "a b " * 4), (903, "a b c " * 4 + "a b c b"), (904, "x x " * 8), (10, "dup " * 9), (10, "dup " * 9)]
    return rows


@pytest.mark.parametrize("rows", [documents(), repetitive(), [(i, prose(i, 60)) for i in range(80)]])
def test_run_report(spark, rows):
    got = periodic.run_report(document_frame(spark, rows), places=periodic.repeated_places).collect()
    assert Counter(map(tuple, got)) == Counter(brute_report(i, t, True) for i, t in rows)


def test_runs_and_collapse(spark):
    rows = repetitive()
    docs = document_frame(spark, rows)
    got = Counter((r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic.runs(docs).collect())
    assert got == Counter((i, *run) for i, t in rows for run in brute_runs(t.encode().split()))
    out = periodic.collapse(docs)
    assert out.columns == docs.columns
    texts = Counter((r["doc_id"], hashlib.sha256(" ".join((r["text"] or "").split(" ")).encode()).hexdigest()) for r in out.where("doc_id >= 900").collect())
    assert texts[(902, hashlib.sha256(b"a b").hexdigest())] == 1
    assert periodic.run_report(document_frame(spark, [])).count() == 0


def test_runs_with_other_bounds():
    r = random.Random(9)
    for _ in range(1500):
        w = [r.randrange(1, r.choice([2, 3, 5]) + 1) for _ in range(r.randrange(50))]
        for least, power in ((2, 2), (3, 3), (6, 4)):
            codes = np.array(w, dtype=np.int64)
            parts = periodic.stretches(codes, np.array([0, len(w)]), least, power)
            found = [(a + s, n, p) for a, b in parts for s, n, p in periodic.runs_of(codes[a:b], least, power).tolist()]
            assert sorted(found, key=lambda x: (x[0], x[2])) == brute_runs(w, least, power)


def test_long_periodic_text():
    word = [f"k{i}" for i in range(2500)]
    _, runs = periodic.document_runs([1], [" ".join(word * 8)])[0]
    assert runs.tolist() == [[0, 20000, 2500]]


def test_packing_keeps_every_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = documents() + [(500 + i, prose(i, 10 + 37 * i)) for i in range(60)] + [(700, "a <|endoftext|> b c 　 \U0001f600")]
    docs = document_frame(spark, rows)
    got = packing.pack(docs, with_ids=True).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(held) <= math.ceil(sum(n for p in held.values() for _, n in p) / 2048) + 1
    out = packing.sequences(spark.createDataFrame(got)).collect()
    assert sum(len(r["ids"]) for r in out) == sum(n for p in held.values() for _, n in p)
    assert packing.pack(document_frame(spark, [])).count() == 0


def test_packing_plan():
    for seed in range(12):
        r = np.random.default_rng(seed)
        size = int(r.choice([8, 64, 512]))
        histogram = np.zeros(size + 1, dtype=np.int64)
        np.add.at(histogram, r.integers(1, size + 1, int(r.choice([1, 30, 3000]))), int(r.choice([1, 50])))
        plan = packing.packing_plan(histogram, size)
        held = np.zeros_like(histogram)
        for lengths, count in plan:
            assert sum(lengths) <= size and count > 0
            np.add.at(held, list(lengths), count)
        assert (held == histogram).all()
        assert sum(c for _, c in plan) <= 1.02 * sum(c for _, c in packing.best_fit(histogram, size)) + 1
    assert packing.full_patterns([1, 2, 3], 4).tolist() == [[3, 1, 0], [2, 2, 0], [2, 1, 1]]
    x = packing.repeat_counts(np.array([[3, 1, 0], [2, 2, 0]]), np.array([0, 10, 8, 10, 0]))
    assert np.allclose(x, [10, 4], atol=0.1)


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    talk = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        talk[c] = own.get(c - c % 5, [])[:h] + v[h:] if rebuild else v
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(talk):
        for d in range(len(talk[c]) + 1):
            members[tuple(talk[c][:d])].append(c)
            if d:
                kids[tuple(talk[c][: d - 1])].add(tuple(talk[c][:d]))
    leaves, saved, out = {}, {}, Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    for k, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(talk[c]) == len(k))
        out[min(ids), len(k), members[k[:-1]][0] if k else None, len(ids), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def talks():
    r, rows = random.Random(2), []
    for c in range(160):
        start = r.randrange(6)
        rows += [(c, t, r.choice(["user", "bot", None]) if t > 2 else "user", f"t{start if t < 2 else r.randrange(2)}é" if r.random() < 0.95 else None) for t in range(r.randrange(0, 12))]
    rows += [(200, t, "user", f"x{t % 3}") for t in range(150)] + [(201, t, "user", f"x{t % 3}" if t < 140 else "end") for t in range(150)]
    rows += [(300 + i, t, "user", "same") for i in range(40) for t in range(3)] + [(None, 0, "user", "lost"), (401, None, "user", "first"), (401, 5, "bot", "then"), (403, 0, "user", ""), (2**40, 0, "", "big")]
    return rows


@pytest.mark.parametrize("band,block,ids", [(8, 1024, 4096), (4, 16, 8)])
@pytest.mark.parametrize("rebuild", [True, False])
def test_conversation_trie(spark, monkeypatch, band, block, ids, rebuild):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", ids)
    rows = talks()
    frame = spark.createDataFrame([(*r, 1, 2, "e") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 long, ends_sha256 string")
    got = trie.conversation_trie(frame, **({} if rebuild else {"rebuild": None}))
    assert Counter(map(tuple, got.collect())) == brute_trie(rows, rebuild)


def test_trie_of_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_trie_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert Counter(map(tuple, op13(spark, "/root/testdata/sf0.001").collect())) == brute_trie(rows)
