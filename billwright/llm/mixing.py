"""Mixing to target weights by soft membership, on DataFrame functions alone.

A labelled table (doc_id, domain) trains a naive Bayes classifier over the presence of frequent
words; it gives every document posteriors over domains. Rates x >= 0 are then fitted so that the
expected token totals per domain, sum over d of x[d] * tokens[d] * posterior[d, k], meet the
targets in least squares. The gradient is taken in x * sqrt(tokens), so a step depends on a document's
posterior and not on its length: documents with equal posteriors get equal rates. It depends on the
other documents only through the
residuals, one number per domain, so each round of projected gradient is one aggregate over the
documents; a document's rate is a fold over the rounds' short history of steps, and no
table is rewritten. Steps are scaled by the inverse of the domains' second moments, which makes
the first step exact where no rate is cut off at zero.

The vocabulary is a bounded parameter; training uses a bounded sample of labelled rows, and every domain in
it is a domain. Defined cases: null and empty texts have no tokens, the prior as posterior, and rate one;
repeated rows are documents each; an empty labelled table gives one domain named "unknown";
a target for a domain that no document can serve is missed, and the others are met; a target that names no labelled domain is an error.
"""

import math

from pyspark.sql import functions as F

from billwright.llm.arrow import packed, unpacked

#: Labelled rows that train the classifier at most, and the number of words it looks at.
SAMPLE, WORDS = 5_000, 200
ROUNDS = 40
TOLERANCE = 1e-6


def _words(text_col):
    return F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")


def classifier(docs, labelled, id_col="doc_id", text_col="text", domain_col="domain", sample=SAMPLE, words=WORDS):
    """{"domains": [...], "prior": [...], "words": {word: [log likelihoods by domain]}} from the labelled rows with the least hash of their id."""
    marked = labelled.select(F.col(id_col).cast("long").alias("_id"), F.col(domain_col).cast("string").alias("_domain")).dropna().dropDuplicates(["_id"])
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("_id", "_domain", F.array_distinct(_words("_text")).alias("_w"))
    sizes = rows.groupBy("_domain").count().orderBy(F.desc("count"), "_domain").collect()  # at most one row per sampled label
    if not sizes:
        return {"domains": ["unknown"], "prior": [0.0], "words": {}}
    names, total = [r["_domain"] for r in sizes], sum(r["count"] for r in sizes)
    place = {name: i for i, name in enumerate(names)}
    seen = rows.select("_domain", F.explode("_w").alias("w")).where("w <> ''")
    frequent = seen.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    counts = seen.join(F.broadcast(frequent.select("w")), "w").groupBy("w", "_domain").count().collect()
    table = {}
    for r in counts:
        table.setdefault(r["w"], [0] * len(names))[place[r["_domain"]]] = r["count"]
    smooth = lambda k, n: math.log((k + 0.5) / (n + 1))
    return {
        "domains": names, "prior": [math.log(r["count"] / total) for r in sizes],
        "words": {w: [smooth(k, r["count"]) for k, r in zip(c, sizes, strict=True)] for w, c in table.items()},
    }


def log_weights(model, text_col="text"):
    """Array of unnormalised log probabilities of a text's domains, in the order of model["domains"]."""
    prior = F.array(*[F.lit(float(x)) for x in model["prior"]])
    if model["words"]:
        names = sorted(model["words"])
        known = F.array_intersect(_words(text_col), F.array(*[F.lit(w) for w in names]))
        table = F.create_map(*[x for w in names for x in (F.lit(w), F.array(*[F.lit(float(v)) for v in model["words"][w]]))])
        prior = F.aggregate(known, prior, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
    return prior


def normalised(logs):
    """Probabilities from a column of log weights."""
    return F.transform(logs, lambda x: 1 / F.aggregate(logs, F.lit(0.0), lambda total, y: total + F.exp(y - x)))


def tokens_of(text_col="text"):
    """White-space tokens of a text."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")).cast("long")


def memberships(docs, model, id_col="doc_id", text_col="text"):
    """(doc_id, n_tokens, p): tokens and domain posteriors of every document row."""
    counted = docs.select(F.col(id_col).alias("doc_id"), log_weights(model, text_col).alias("_logs"), tokens_of(text_col).alias("n_tokens"))
    return counted.select("doc_id", "n_tokens", normalised(F.col("_logs")).alias("p"))


def _inverse(m):
    """Inverse of a small symmetric matrix with a ridge on the diagonal, by elimination."""
    k = len(m)
    ridge = 1e-9 * max(1e-300, max(m[i][i] for i in range(k)))
    a = [[m[i][j] + (ridge if i == j else 0.0) for j in range(k)] + [float(i == j) for j in range(k)] for i in range(k)]
    for i in range(k):
        best = max(range(i, k), key=lambda r: abs(a[r][i]))
        a[i], a[best] = a[best], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(k):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[k:] for row in a]


def _shares(there, k):
    """Share of all tokens that a document brings to each domain."""
    return [F.col("n_tokens") / F.lit(float(there)) * F.element_at("p", i + 1) for i in range(k)]


def _pulls(k):
    """How far a step of one in each domain moves a document: its posteriors, zero without tokens."""
    return [F.when(F.col("n_tokens") > 0, F.element_at("p", i + 1)).otherwise(0.0) for i in range(k)]


def _rate(steps, pulls):
    """Rate of a document after the steps: a fold of projected steps from one."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    dot = lambda s: sum((F.element_at(s, i + 1) * a for i, a in enumerate(pulls)), F.lit(0.0))
    return F.aggregate(history, F.lit(1.0), lambda x, s: F.greatest(F.lit(0.0), x - dot(s)))


def fit_rates(members, targets, domains, total=None, rounds=ROUNDS, tolerance=TOLERANCE):
    """(tokens there are, steps) of the projected gradient; targets: {domain: share of the total}, total: tokens wanted (default: those there are)."""
    k = len(domains)
    there = members.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    if not there:
        return 1, []
    wanted = [targets.get(d, 0.0) * (total or there) / there for d in domains]
    rows = members.withColumns({f"_a{i}": a for i, a in enumerate(_shares(there, k))} | {f"_p{i}": p for i, p in enumerate(_pulls(k))})
    names, pulls = [f"_a{i}" for i in range(k)], [F.col(f"_p{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    steps = []
    for _ in range(rounds):
        live = rows.withColumn("_x", _rate(steps, pulls))
        # residuals, and second moments of the documents that aren't cut off
        sums = live.agg(
            *[F.sum(F.col("_x") * F.col(n)).alias(f"s{i}") for i, n in enumerate(names)],
            *[F.sum(F.when(F.col("_x") > 0, F.col(names[i]) * pulls[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        residual = [sums[f"s{i}"] - wanted[i] for i in range(k)]
        if max(map(abs, residual)) < tolerance:
            break
        m = [[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
        inverse = _inverse(m)
        steps.append([sum(inverse[i][j] * residual[j] for j in range(k)) for i in range(k)])
    return there, steps


def with_rates(members, domains, there, steps):
    """members with the columns ``domain`` (the likeliest) and ``rate``."""
    named = F.array(*[F.lit(d) for d in domains])
    likeliest = F.element_at(named, F.array_position("p", F.array_max("p")).cast("int"))
    return members.withColumn("domain", likeliest).withColumn("rate", _rate(steps, _pulls(len(domains))))


def _fitted(docs, labelled, targets, settle, id_col, text_col, domain_col, options):
    model = classifier(docs, labelled, id_col, text_col, domain_col)
    names = model["domains"]
    if unknown := sorted(set(targets or {}) - set(names)):
        raise ValueError(f"targets name domains without labelled documents: {unknown}")
    members = settle(memberships(docs, model, id_col, text_col), "members")
    there, steps = fit_rates(members, targets or {d: 1 / len(names) for d in names}, names, **options)
    return model, members, there, steps


def mix(docs, labelled, targets=None, settle=lambda df, name: df, id_col="doc_id", text_col="text", domain_col="domain", **options):
    """doc_id, n_tokens, domain, p_<domain> for every domain, rate. Without targets every domain gets the same share."""
    model, members, there, steps = _fitted(docs, labelled, targets, settle, id_col, text_col, domain_col, options)
    out = with_rates(members, model["domains"], there, steps)
    return out.select("doc_id", "n_tokens", "domain", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(model["domains"])], "rate")


def mixed(docs, labelled, targets=None, settle=lambda df, name: df, id_col="doc_id", text_col="text", domain_col="domain", **options):
    """Every document, with ``domain``, ``rate`` and ``copies``: the rate rounded up or down by chance, fixed by id; no copies at rate zero."""
    model, _, there, steps = _fitted(docs, labelled, targets, settle, id_col, text_col, domain_col, options)
    counted = packed(docs, text_col).withColumn("_logs", log_weights(model)).withColumn("n_tokens", tokens_of()).withColumn("p", normalised(F.col("_logs")))
    rated = with_rates(counted, model["domains"], there, steps)
    chance = F.pmod(F.xxhash64(F.col(f"row.`{id_col}`"), F.lit(8)), F.lit(1 << 20)) / F.lit(1 << 20)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return unpacked(rated, docs, text_col, domain=F.col("domain"), rate=F.col("rate"), copies=copies)
