"""Catalog vocabulary: categories, rank, features, sizes, tiers."""

from functools import reduce

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.text import contains_any, count_words


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _chain(pairs, default):
    """First true condition wins; built back to front so the plan stays one CASE."""
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def category_of(text, taxonomy=rules.TAXONOMY):
    """First category whose pattern hits, in table order."""
    text = F.coalesce(_c(text), F.lit(""))
    kind = "struct<main:string,sub:string>"
    pairs = [
        (text.rlike("(?i)" + pattern), F.struct(F.lit(main).alias("main"), F.lit(sub).alias("sub")))
        for main, sub, pattern in taxonomy
    ]
    return _chain(pairs, F.lit(None).cast(kind))


def categories_of(text, taxonomy=rules.TAXONOMY):
    """Every category that hits, in table order."""
    text = F.coalesce(_c(text), F.lit(""))
    return F.array_compact(
        F.array(
            *[
                F.when(
                    text.rlike("(?i)" + pattern),
                    F.struct(F.lit(main).alias("main"), F.lit(sub).alias("sub")),
                )
                for main, sub, pattern in taxonomy
            ]
        )
    )


def keyword_category(text, tier, table=rules.KEYWORD_CATEGORIES, ranks=rules.TIER_RANK):
    """Category with most keyword hits, first on ties; its first sub category with a hit."""
    text = F.lower(F.coalesce(_c(text), F.lit("")))
    scored = F.array(
        *[
            F.struct(
                count_words(text, words).alias("score"),
                F.lit(-i).alias("first"),
                F.lit(category).alias("category"),
                _chain([(contains_any(text, kws), F.lit(sub)) for sub, kws in subs.items()], F.lit("General")).alias(
                    "sub"
                ),
            )
            for i, (category, (words, subs)) in enumerate(table.items())
        ]
    )
    best = F.array_max(scored)
    hit = best["score"] > 0
    tier = F.lower(F.coalesce(_c(tier), F.lit("")))
    rank = _chain([(tier == name, F.lit(value)) for name, value in ranks.items()], F.lit(2))
    return F.struct(
        F.when(hit, best["category"]).otherwise(F.lit("Furniture")).alias("category"),
        F.when(hit, best["sub"]).otherwise(F.lit("General")).alias("sub_category"),
        rank.alias("rank"),
    )


def bucket_of(text, buckets=rules.BUCKETS):
    """First of the ordered buckets with a keyword in the text, else null."""
    text = F.lower(F.coalesce(_c(text), F.lit("")))
    return _chain(
        [(contains_any(text, words), F.lit(name)) for name, _, _, words in buckets],
        F.lit(None).cast("string"),
    )


def seniority(text, ranks=rules.RANKS):
    """Seniority 4 to 1, first pattern that hits."""
    text = F.coalesce(_c(text), F.lit(""))
    return _chain([(text.rlike("(?i)" + p), F.lit(rank)) for rank, p in ranks], F.lit(None).cast("int"))


def features_of(text, features=rules.FEATURES):
    """Feature tags in table order."""
    text = F.coalesce(_c(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(tag)) for _, tag, p in features]))


def size_of(text):
    """Width, depth and the text they came from; centimetres become millimetres."""
    text = F.coalesce(_c(text), F.lit(""))
    raw = F.regexp_extract(text, rules.SIZE_PATTERN, 0)
    w0 = F.regexp_extract(text, rules.SIZE_PATTERN, 1).try_cast("int")
    d0 = F.regexp_extract(text, rules.SIZE_PATTERN, 2).try_cast("int")
    scale = F.when((w0 < 250) & (d0 < 250), F.lit(10)).otherwise(F.lit(1))
    w, d = w0 * scale, d0 * scale
    turn = (d > w) & (d > 500)
    round_raw = F.regexp_extract(text, rules.ROUND_PATTERN, 0)
    r0 = F.regexp_extract(text, rules.ROUND_PATTERN, 1).try_cast("int")
    r = F.when(r0 < 250, r0 * 10).otherwise(r0)

    def size(width, depth, source):
        return F.struct(width.alias("width"), depth.alias("depth"), source.alias("raw"))

    return F.when(
        raw != "", size(F.when(turn, d).otherwise(w), F.when(turn, w).otherwise(d), raw)
    ).when(round_raw != "", size(r, r, round_raw))


def tier_of(x):
    """Three tiers: premium is high, unknown is mid."""
    tier = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    return (
        F.when(tier.isin("high", "premium"), F.lit("high"))
        .when(tier == "budgetary", F.lit("budgetary"))
        .otherwise(F.lit("mid"))
    )


def tier_from_file(file_name, tier=None):
    """Stored tier, else the one in the file name, else mid."""
    named = F.regexp_extract(_c(file_name), r"(budgetary|mid|high)", 1)
    stored = F.lit(None).cast("string") if tier is None else F.nullif(_c(tier), F.lit(""))
    return F.coalesce(stored, F.nullif(named, F.lit("")), F.lit("mid"))


def snap_category(main, sub, taxonomy=rules.TAXONOMY):
    """Known spelling of a category pair; Furniture and its first sub category otherwise."""
    main, sub = F.lower(F.coalesce(_c(main), F.lit(""))), F.lower(F.coalesce(_c(sub), F.lit("")))
    groups = reduce(lambda acc, row: {**acc, row[0]: acc.get(row[0], []) + [row[1]]}, taxonomy, {})

    def pick(name, subs):
        known = _chain([(sub == s.lower(), F.lit(s)) for s in subs], F.lit(subs[0]))
        return F.struct(F.lit(name).alias("main"), known.alias("sub"))

    fallback = pick("Furniture", groups["Furniture"]) if "Furniture" in groups else F.struct(
        F.lit("Furniture").alias("main"), F.lit("General").alias("sub")
    )
    return _chain([(main == name.lower(), pick(name, subs)) for name, subs in groups.items()], fallback)


def is_kept_product(family, model, description, main, sub, image_url):
    """False for error pages, material samples and bare discoveries without an image."""
    text = F.lower(
        F.concat_ws(" ", *[F.coalesce(F.trim(_c(c)), F.lit("")) for c in (family, model, description, main, sub)])
    )
    discovery = F.lower(F.concat_ws(" ", _c(sub), _c(main))).contains("discovery")
    no_image = F.length(F.coalesce(_c(image_url), F.lit(""))) <= 10
    return ~(text.rlike(rules.ERROR_PAGE) | text.rlike(rules.MATERIAL_SAMPLE) | (discovery & no_image))


