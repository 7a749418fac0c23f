"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def near(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def documents():
    base, rows = prose(0, 120), []
    rows += [(1, base), (2, base), (2, base), (3, near(base, 3, 2)), (4, near(base, 4, 4)), (5, near(base, 5, 40))]
    rows += [(6, None), (7, ""), (8, "   \n\t "), (9, "one two"), (10, "One Two"), (11, "solo"), (12, prose(12, 30) + "\n" + prose(0, 120)[:400])]
    rows += [(13, "a" * 3000), (14, "a" * 3000 + "b"), (15, prose(15, 4000)), (16, "é" * 250 + " ü 😀 " + prose(16)), (None, prose(17)), (None, None)]
    rows += [(20 + i, near(prose(99, 80), i, i % 5)) for i in range(12)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_hit long, score string, node long, base string, rate string, email string, _id long"


def document_frame(spark, rows=None):
    """documents with extra columns that clash with the operators' working names."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 7, "s", 1, "b", "r", "e", 5) for i, t in rows], SCHEMA)
