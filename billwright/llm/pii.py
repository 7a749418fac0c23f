"""Personal data by weak supervision, on DataFrame functions alone.

Base spans come from fixed patterns with checks. Further spans start as generous candidates (local
telephone numbers, secrets, account numbers). Labelers vote on each candidate: strict patterns,
a gazetteer of leading words, the characters around it and its make-up. Expectation maximisation
over the counts of vote patterns estimates the labelers' reliabilities (starting from, and held
near, the belief that they are better than chance), its posteriors train a
logistic span classifier over votes and make-up, and the classifier decides. Both fits need only
counts by pattern: a table bounded by the number of patterns (``3 ** 4`` votes times ``4 * 3``
make-ups times the kinds), whatever the corpus holds.

Positions are code points, ends exclusive. Patterns are possessive and look behind, so that a text
of any length is read in one pass. Defined cases: a null text is empty and has no spans;
repeated rows have equal spans; a kind without candidates adds nothing.
"""

import math

from pyspark.sql import functions as F

from billwright.llm.arrow import packed, unpacked

# fixed values: base patterns, each equal in its matches to the plain form it stands for
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# fixed values: candidate patterns
LOCAL_PHONE = r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}"
ACCOUNT = r"(?<![0-9A-Za-z.-])[0-9]{8,13}+(?![0-9A-Za-z])"
# fixed values: leading words and beginnings that speak for a kind
LEADING = {
    "local_phone": "tel|telephone|phone|call|mobile|cell|fax|whatsapp|telefon|tél|téléphone|teléfono",
    "secret": "password|passwd|pwd|token|secret|key|apikey|api_key|bearer|authorization|credential",
    "account": "account|acct|iban|konto|cuenta|compte|ssn|passport|customer|policy|licence|license",
}
BEGINNINGS = {"local_phone": r"\([0-9]{3}\)", "secret": "AKIA|ASIA|ghp_|gho_|sk_|sk-|xox|eyJ|AIza", "account": "[0-9]{9}$"}
STRICT = {
    "local_phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{16,}|[A-Za-z0-9_+/-]{20,}={0,2}",
    "account": r"[0-9]{9,12}",
}
BASE = ["email", "ip", "card", "phone"]
ADDED = ["local_phone", "secret", "account"]
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "local_phone": LOCAL_PHONE, "secret": SECRET, "account": ACCOUNT}
VOTES = ["strict", "gazetteer", "context", "make"]
#: What labelers are believed to do before counting, with the weight of all candidates: chance of the vote on a true and on a false span.
BELIEF = {1: (0.6, 0.1), 0: (0.3, 0.4), -1: (0.1, 0.5)}
_BLOCK = 256


def _located(df, kind):
    """Column ``kind``: the pattern's matches with place, neighbours and text; from the pieces between them."""
    p, h, n, b = (f"_{x}_{kind}" for x in ("pieces", "hits", "lengths", "blocks"))
    zero, add = F.lit(0), lambda a, x: a + x
    df = df.withColumn(p, F.split("_text", PATTERNS[kind], -1)).withColumn(h, F.regexp_extract_all("_text", F.lit(PATTERNS[kind]), F.lit(0)))
    df = df.withColumn(n, F.transform(h, lambda x, i: F.length(F.get(p, i)) + F.length(x)))
    df = df.withColumn(b, F.transform(F.sequence(zero, F.floor(F.size(h) / _BLOCK).cast("int")), lambda k: F.aggregate(F.slice(n, 1, k * _BLOCK), zero, add)))

    def place(x, i):
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(b, block) + F.aggregate(F.slice(n, block * _BLOCK + 1, i % _BLOCK), zero, add) + F.length(F.get(p, i))
        return F.struct(start.alias("start"), (start + F.length(x)).alias("stop"), x.alias("hit"), F.right(F.get(p, i), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(2)).alias("after"))

    return df.withColumn(kind, F.transform(h, place)).drop(p, h, n, b)


def _valid(kind, hit):
    digits = F.regexp_replace(hit, "[^0-9]", "")
    count = F.length(digits)
    return {
        "email": F.lit(True), "ip": hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": count.between(14, 19) & F.call_function("luhn_check", digits), "phone": count.between(10, 15),
    }[kind]


def _votes(kind, x):
    hit, before, after = x["hit"], x["before"], x["after"]
    sign = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    digits, letters = F.length(F.regexp_replace(hit, "[^0-9]", "")), F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    led = before.rlike(rf"(?i)(?:^|[^a-z])(?:{LEADING[kind]})[\"' ]{{0,2}}[:=#]?[\"' ]{{0,3}}$") | hit.rlike(f"^(?:{BEGINNINGS[kind]})")
    mixed = (digits >= 4) & (letters >= 4) if kind == "secret" else F.size(F.array_distinct(F.split(hit, ""))) >= 5
    return {
        "strict": F.when(hit.rlike(f"^(?:{STRICT[kind]})$"), 1).otherwise(-1), "gazetteer": sign(led),
        "context": sign(before.rlike(r"[:=\"'#]\s?$"), before.rlike(r"[A-Za-z0-9/_.-]$") | after.rlike(r"^[A-Za-z0-9/_-]")),
        "make": F.when(mixed, 1).otherwise(-1),
    } | {
        "length": F.when(F.length(hit) < 12, 0).when(F.length(hit) < 18, 1).when(F.length(hit) < 32, 2).otherwise(3),
        "share": F.floor(2.99 * digits / F.length(hit)).cast("int"),
    }


def annotate(docs, text_col="text"):
    """Columns ``base`` (spans) and ``cands`` (candidates outside the base spans, with votes and make-up)."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    for kind in PATTERNS:
        df = _located(df, kind)
    def base_spans(i, kind):
        held = F.filter(kind, lambda x: _valid(kind, x["hit"]))
        return F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))

    def free(x):
        return ~F.exists("base", lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))

    def candidates(i, kind):
        def row(x):
            made = [v.alias(n) for n, v in _votes(kind, x).items()]
            return F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), *made)

        return F.transform(F.filter(kind, free), row)

    df = df.withColumn("base", F.array_sort(F.concat(*[base_spans(i, k) for i, k in enumerate(BASE)])))
    cands = F.concat(*[candidates(len(BASE) + i, k) for i, k in enumerate(ADDED)])
    return df.withColumn("cands", cands).drop("_text", *PATTERNS)


def _posteriors(counts, rounds=30):
    """Expectation maximisation with two classes and independent labelers: probability of each vote pattern."""
    p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in counts}
    for _ in range(rounds):
        total = sum(counts.values())
        yes = sum(counts[v] * p[v] for v in counts)
        prior = (yes + 1) / (total + 2)
        rate = {}
        for j in range(len(VOTES)):
            for value in (-1, 0, 1):
                a = sum(counts[v] * p[v] for v in counts if v[j] == value)
                b = sum(counts[v] * (1 - p[v]) for v in counts if v[j] == value)
                own, other = BELIEF[value]
                rate[j, value] = (a + own * total) / (yes + total), (b + other * total) / (total - yes + total)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, x][0] / rate[j, x][1]) for j, x in enumerate(v))
            p[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return p


def _features(row):
    """Design of the span classifier: intercept, votes, length class, share class."""
    return [1.0, *[float(row[v]) for v in VOTES], *[float(row["length"] == k) for k in range(4)], *[float(row["share"] == k) for k in range(3)]]


def _logistic(rows, rounds=300, rate=2.0, ridge=1e-3):
    total, width = sum(n for _, _, n in rows), len(rows[0][0])
    w = [0.0] * width
    for _ in range(rounds):
        g = [ridge * x for x in w]
        for x, target, n in rows:
            e = n / total * (1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True)))))) - target)
            for k in range(width):
                g[k] += e * x[k]
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def fit(annotated):
    """Span classifier per kind from the counts of vote and make-up patterns."""
    flat = annotated.select(F.explode("cands").alias("c")).select("c.kind", *[f"c.{v}" for v in VOTES], "c.length", "c.share")
    counts = flat.groupBy("kind", *VOTES, "length", "share").count().collect()
    model = {}
    for kind in ADDED:
        own = [r for r in counts if r["kind"] == kind]
        if not own:
            continue
        by_vote = {}
        for r in own:
            key = tuple(r[v] for v in VOTES)
            by_vote[key] = by_vote.get(key, 0) + r["count"]
        p = _posteriors(by_vote)
        model[kind] = _logistic([(_features(r), p[tuple(r[v] for v in VOTES)], r["count"]) for r in own])
    return model


def _accepted(model):
    """Whether the classifier takes a candidate."""

    def of(c):
        out = F.lit(False)
        for kind, w in model.items():
            score = F.lit(w[0])
            for k, v in enumerate(VOTES):
                score = score + F.lit(w[1 + k]) * c[v]
            at = 1 + len(VOTES)
            for name, n in (("length", 4), ("share", 3)):
                score = score + F.element_at(F.array(*[F.lit(x) for x in w[at : at + n]]), c[name] + 1)
                at += n
            out = F.when(c["kind"] == kind, score > 0).otherwise(out)
        return out

    return of


def spans(annotated, model):
    """Column ``spans``: base spans and accepted candidates in order; ``base`` and ``cands`` stay."""
    plain = F.transform(F.filter("cands", _accepted(model)), lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    return annotated.withColumn("spans", F.array_sort(F.concat("base", plain)))


def listed(column):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs, settle=lambda df, name: df):
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and the number of added ones."""
    annotated = settle(annotate(docs.select("doc_id", "text")).select("doc_id", "base", "cands"), "pii")
    marked = spans(annotated, fit(annotated))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return marked.select(
        "doc_id", *map(count, BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def mask(docs, text_col="text", settle=lambda df, name: df):
    """The documents with every span replaced by its kind in brackets; n_chars, where present, follows."""
    rows = packed(docs, text_col)
    counts = settle(annotate(rows.select("text")).select("cands"), "pii")
    marked = spans(annotate(rows), fit(counts))
    text, zero = F.coalesce("text", F.lit("")), F.lit(0)
    # how far the spans before the i-th reach: spans of different kinds may overlap
    reach = lambda i: F.aggregate(F.slice("spans", 1, i), zero, lambda a, s: F.greatest(a, s["stop"]))

    def piece(s, i):
        name = F.when(s["stop"] > reach(i), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.substring(text, reach(i) + 1, F.greatest(zero, s["start"] - reach(i))), name)

    masked = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(text, reach(F.size("spans")) + 1, F.length(text)))
    out = marked.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    if "n_chars" not in docs.columns:
        return unpacked(out, docs, text_col)
    length = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(out, docs, text_col, n_chars=length)
