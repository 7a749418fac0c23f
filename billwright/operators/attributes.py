"""Match by attributes over the whole catalog: category, size, seniority, naming words.

No source describes this matcher; only its known outcomes exist. The weights below were chosen so
that those outcomes hold. Both sides reduce to a signature (categories, size, rank, tags and the
words of the fixed category vocabulary), so lines and products meet once per signature, not once
per row, and by what they share (size, sub category, word, tag), never by their main category alone.
"""

import re

from pyspark.sql import functions as F

from billwright import rules
from billwright.operators.settle import settle
from billwright.functions.tagging import categories_of, features_of, seniority, size_of

# Weights: same sub category, same main category, same size, share of line words named (plain
# furniture nouns count half),
# per step of rank distance beyond the first, per shared feature tag.
WEIGHTS = {"sub": 3.0, "main": 1.0, "size": 2.0, "words": 4.0, "rank": -0.1, "tags": 0.25}
LEAST = 2.0
#: Hooks of a line that one round looks up.
AT_ONCE = 3


def naming_words(taxonomy=rules.TAXONOMY):
    """Words that occur in the category patterns: the fixed vocabulary both sides are read with."""
    words = set()
    for _, _, pattern in taxonomy:
        plain = re.sub(r"\\b|\(\?!.*?\)", " ", pattern)
        words.update(w for w in re.findall(r"[a-z]+", plain) if len(w) > 2)
    return sorted(words)


def _named(text, words):
    known = F.array(*[F.lit(w) for w in words])
    own = F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "))
    return F.array_sort(F.array_intersect(own, known))


def _signature(df, text, words, taxonomy):
    size = size_of(text)
    return (
        df.withColumn("size", F.when(size.isNotNull(), F.concat_ws("x", size["width"], size["depth"])))
        .withColumn("rank", seniority(text))
        .withColumn("tags", F.array_sort(features_of(text)))
        .withColumn("words", _named(text, words))
        .withColumn("groups", categories_of(text, taxonomy))
    )


_SHAPE = ["rank", "tags", "words", "mains", "subs"]
_TOP = "struct<neg:double,pos:bigint>"


def _score(w, sized):
    """Score of a line shape against a product frame of one of its main categories."""
    nouns = F.array(*[F.lit(n) for n in rules.SYNONYMS])
    worth = lambda ws: F.size(ws) - F.size(F.array_intersect(ws, nouns)) * 0.5
    score = (
        F.lit(w["main"])
        + F.when(F.array_contains("subs", F.col("sub")), w["sub"]).otherwise(0.0)
        + F.lit(w["size"] if sized else 0.0)
        + F.when(F.size("words") > 0, worth(F.array_intersect("words", "p_words")) * w["words"] / worth(F.col("words"))).otherwise(0.0)
        + F.greatest(F.coalesce(F.abs(F.col("rank") - F.col("p_rank")), F.lit(0)) - 1, F.lit(0)) * w["rank"]
        + F.size(F.array_intersect("tags", "p_tags")) * w["tags"]
    )
    return F.round(score, 6)


def _best(joined, keys, w, sized):
    return joined.withColumn("score", _score(w, sized)).groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("neg"), "pos")).cast(_TOP).alias("best"))


def _hooks(w):
    """What a line can share with a product, the heaviest first: (hook, weight, weight of all that follow)."""
    nouns = F.array(*[F.lit(n) for n in rules.SYNONYMS])
    share = lambda x: F.when(F.array_contains(nouns, x), 0.5).otherwise(1.0)
    whole = F.aggregate("words", F.lit(0.0), lambda a, x: a + share(x))
    hook = lambda kind, x, weight: F.struct(weight.cast("double").alias("weight"), F.concat(F.lit(kind), x).alias("hook"))
    every = F.concat(
        F.transform("subs", lambda x: hook("sub:", x, F.lit(w["sub"]))),
        F.transform("words", lambda x: hook("word:", x, share(x) * w["words"] / whole)),
        F.transform("tags", lambda x: hook("tag:", x, F.lit(w["tags"]))),
    )
    return F.reverse(F.array_sort(every))


def _by_threshold(shapes, frames, w, least):
    """Best frame per shape, whatever the sizes: the hooks of a shape are looked up a few at a time, the heaviest first.

    A frame that shares none of the hooks seen so far scores at most the main category and the hooks to come, so a shape is done
    once that bound falls below its best, or below ``least``. A line has as many hooks as it has words and tags of the
    fixed vocabulary; each round joins the open shapes with one posting list, and all lists are read with (main, hook) as key.
    """
    postings = frames.withColumn(
        "hook",
        F.explode(F.concat(
            F.array(F.concat(F.lit("sub:"), F.coalesce("sub", F.lit("")))),
            F.transform("p_words", lambda x: F.concat(F.lit("word:"), x)),
            F.transform("p_tags", lambda x: F.concat(F.lit("tag:"), x)),
        )),
    )
    postings = settle(postings, "postings")
    # Of several sub categories a product has one, so the bound counts them once.
    to_come = F.slice("hooks", F.col("k") + 1, F.size("hooks"))
    rest = F.lit(w["main"]) + F.aggregate(F.filter(to_come, lambda h: ~h["hook"].startswith("sub:")), F.lit(0.0), lambda a, h: a + h["weight"]) + F.when(
        F.exists(to_come, lambda h: h["hook"].startswith("sub:")), w["sub"]
    ).otherwise(0.0)
    state = shapes.withColumns({"hooks": _hooks(w), "k": F.lit(0), "best": F.lit(None).cast(_TOP)})
    found = None
    while True:
        bound = F.round(rest, 6) + 1e-6
        going = (F.col("k") < F.size("hooks")) & (bound >= F.coalesce(-F.col("best.neg"), F.lit(least))) & (bound >= least)
        state = settle(state.withColumn("going", going), "shapes")
        done = state.where("not going and best is not null").select("_s", "best")
        found = done if found is None else found.unionByName(done)
        open_shapes = state.where("going").drop("going")
        if open_shapes.isEmpty():
            return found.groupBy("_s").agg(F.min("best").alias("best"))
        asked = open_shapes.withColumn("hook", F.explode(F.transform(F.slice("hooks", F.col("k") + 1, F.lit(AT_ONCE)), lambda h: h["hook"])))
        hit = _best(asked.drop("best").join(postings, ["main", "hook"]), ["_s", "main"], w, sized=False).withColumnRenamed("best", "hit")
        better = F.least("best", "hit")  # least() passes over nulls
        state = open_shapes.join(hit, ["_s", "main"], "left").withColumns({"best": better, "k": F.col("k") + AT_ONCE}).drop("hit")


def match_by_attributes(lines, products, taxonomy=rules.TAXONOMY, weights=None, least=LEAST):
    """Best product per distinct description: catalog_pos, confidence.

    ``products``: catalog_pos (order over the whole catalog), model, description, main_category,
    sub_category. Lines without any category are left unmatched. Products of the line's size are found by an
    equality join; all others by what they share besides (``_by_threshold``), for which both sides forget their sizes.
    """
    w = weights or WEIGHTS
    words = naming_words(taxonomy)
    wanted = _signature(lines.select("description").distinct(), F.coalesce("description", F.lit("")), words, taxonomy)
    wanted = wanted.withColumn("mains", F.array_distinct(F.transform("groups", lambda g: g["main"]))).withColumn(
        "subs", F.array_distinct(F.transform("groups", lambda g: g["sub"]))
    )
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wanted = wanted.withColumn("_s", F.concat_ws("|", filled("rank"), *[F.concat_ws(",", c) for c in ("tags", "words", "mains", "subs")]))
    wanted = settle(wanted.drop("groups"), "lines")
    texts = F.concat_ws(" ", "model", "description")
    items = products.groupBy("model", "description", "main_category", "sub_category").agg(F.min("catalog_pos").alias("pos"))
    columns = {"main_category": "main", "sub_category": "sub", "size": "p_size", "rank": "p_rank", "tags": "p_tags", "words": "p_words"}
    have = _signature(items, texts, words, taxonomy).select(*[F.col(a).alias(b) for a, b in columns.items()], "pos")
    have = settle(have.groupBy(*columns.values()).agg(F.min("pos").cast("bigint").alias("pos")), "products")

    frames = have.groupBy("main", "sub", "p_rank", "p_tags", "p_words").agg(F.min("pos").alias("pos"))
    shapes = wanted.select("_s", *_SHAPE).dropDuplicates(["_s"]).withColumn("main", F.explode("mains"))
    unsized = _by_threshold(shapes, frames, w, least)
    sized = wanted.where("size is not null").select("_s", "size", *_SHAPE).dropDuplicates(["_s", "size"]).withColumn("main", F.explode("mains"))
    same_size = _best(sized.join(have.withColumnRenamed("p_size", "size"), ["main", "size"]), ["_s", "size"], w, sized=True).withColumnRenamed("best", "sized")
    best = F.least("best", "sized")
    matched = wanted.join(unsized, "_s", "left").join(same_size, ["_s", "size"], "left").withColumn("best", best)
    return matched.select(
        "description",
        F.when(-F.col("best.neg") >= least, F.col("best.pos")).alias("catalog_pos"),
        F.when(-F.col("best.neg") >= least, -F.col("best.neg")).alias("confidence"),
    )
