"""Line items to catalog products by brand, tier and model name.

Catalog columns: brand_id, pos (order inside the brand), model, main_category, sub_category, …
Matching works on distinct keys and joins the outcome back, so repeated lines cost nothing.
"""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import blank, money, parse_number
from billwright.functions.text import model_key, name_key, strip_room
from billwright.operators.containment import around, inside
from billwright.operators.ordering import first_row, first_rows
from billwright.operators.settle import settle

_BEST = "struct<neg:double,pos:bigint>"


# --------------------------------------------------------------------------- M2, M3, M4, M5


def isolate_tiers(candidates, brands):
    """Keep candidate brands that are unknown or belong to the requested tier (M2)."""
    known = (
        brands.groupBy(name_key("name").alias("_key"))
        .agg(F.min_by(F.coalesce(F.nullif(F.lower("tier"), F.lit("")), F.lit("mid")), "brand_order").alias("_tier"))
    )
    return (
        candidates.withColumn("_key", name_key("candidate_brand"))
        .join(known, "_key", "left")
        .where(F.col("_tier").isNull() | (F.col("_tier") == F.lower("tier")))
        .drop("_key", "_tier")
    )


def resolve_brands(wanted, brands, brand_col="brand", tier_col="tier"):
    """Brand of a name: the requested tier when there is one, else the first (M3).

    With ``tier_col=None`` the first brand of the name is taken.
    """
    keyed = brands.select(
        name_key("name").alias("_key"),
        F.coalesce(F.nullif(F.lower("tier"), F.lit("")), F.lit("mid")).alias("_tier"),
        F.struct("brand_id", F.coalesce("logo", F.lit("")).alias("logo"), "tier").alias("_brand"),
        "brand_order",
    )
    first = keyed.groupBy("_key").agg(F.min_by("_brand", "brand_order").alias("_first"))
    out = wanted.withColumn("_key", name_key(brand_col)).join(first, "_key", "left")
    chosen = F.col("_first")
    if tier_col is not None:
        exact = keyed.groupBy("_key", "_tier").agg(F.min_by("_brand", "brand_order").alias("_exact"))
        out = out.withColumn("_tier", F.lower(tier_col)).join(exact, ["_key", "_tier"], "left")
        chosen = F.coalesce("_exact", "_first")
    return out.select(
        *wanted.columns,
        chosen["brand_id"].alias("brand_id"),
        chosen["logo"].alias("brand_logo"),
        chosen["tier"].alias("brand_tier"),
    )


def candidate_context(products, most=None):
    """What an identification step may know of each brand, one row per entry (M4): its sub categories, and its models, all or the first ``most``.

    kind ('sub_category' or 'model'), brand_id, pos (of a model in its brand) and text. A brand of any size is rows, never one array.
    """
    subs = products.where(~blank("sub_category")).select("brand_id", F.col("sub_category").alias("text")).distinct()
    models = products if most is None else first_rows(products, ["brand_id"], ["pos"], most)
    return models.select("brand_id", F.lit("model").alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("model").alias("text")).unionByName(
        subs.select("brand_id", F.lit("sub_category").alias("kind"), F.lit(None).cast("long").alias("pos"), "text")
    )


def first_success(matches, line=("doc_id", "sn", "tier")):
    """Brand order first, then catalog before discovery: one match per line (M5)."""
    return first_row(matches, list(line), ["candidate_order", "source_rank"])


# --------------------------------------------------------------------------- M1


def _synonym_map(synonyms):
    pairs = []
    for word, others in synonyms.items():
        pairs += [F.lit(word), F.array(*[F.lit(o) for o in others])]
    return F.create_map(*pairs)


def _usable(words):
    """Words that count for the score: longer than two letters, or numbers."""
    return F.filter(words, lambda w: (F.length(w) > 2) | w.rlike(r"^\d+$"))


def _score(synonyms):
    """Shared words over the longer word list, plus a quarter per missing word with a synonym hit.

    Catalog words keep duplicates, target words are a set; the bonus runs over all target words.
    Needs the word columns of ``_keys`` and ``_catalog``.
    """
    table = _synonym_map(synonyms)
    tw, pw = F.col("t_words"), F.col("p_words")
    shared = F.size(F.filter(pw, lambda w: F.array_contains(tw, w)))
    base = shared / F.greatest(F.size(tw), F.size(pw))
    helped = F.filter(
        F.col("t_nouns"),
        lambda w: ~F.array_contains(pw, w)
        & F.coalesce(F.arrays_overlap(F.try_element_at(table, w), F.col("p_all")), F.lit(False)),
    )
    bonus = F.when(shared < F.size(tw), F.size(helped) * 0.25).otherwise(F.lit(0.0))
    return F.when(F.size(tw) == 0, F.lit(0.0)).otherwise(base + bonus)


def _with_target_words(keys, synonyms):
    """All words, usable distinct words, and the words (with repeats) that have synonyms."""
    nouns = F.array(*[F.lit(w) for w in synonyms])
    return (
        keys.withColumn("t_all", F.split("t_key", " "))
        .withColumn("t_words", F.array_distinct(_usable(F.col("t_all"))))
        .withColumn("t_nouns", F.filter("t_all", lambda w: F.array_contains(nouns, w)))
    )


def _catalog(products):
    """Distinct (brand, key, categories) with the first position; copies collapse here."""
    return (
        products.select(
            "brand_id",
            model_key("model").alias("p_key"),
            F.lower(F.coalesce("main_category", F.lit(""))).alias("main"),
            F.lower(F.coalesce("sub_category", F.lit(""))).alias("sub"),
            F.col("pos").cast("bigint").alias("pos"),
        )
        .groupBy("brand_id", "p_key", "main", "sub")
        .agg(F.min("pos").alias("pos"))
        .withColumn("p_all", F.split("p_key", " "))
        .withColumn("p_words", _usable(F.col("p_all")))
    )


def _best(pairs, synonyms):
    """Best product per target and category pair, and the first one."""
    scored = pairs.withColumn("score", _score(synonyms))
    return scored.groupBy("brand_id", "t_key", "main", "sub").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "pos")).cast(_BEST).alias("best"),
        F.min("pos").alias("first_pos"),
    )


def _word_candidates(keys, catalog, synonyms):
    """Targets without a containment match: categories reachable by a shared word or a synonym."""
    table = _synonym_map(synonyms)
    reach = F.array_distinct(
        F.concat("t_all", F.flatten(F.transform("t_nouns", lambda w: F.try_element_at(table, w))))
    )
    index = (
        catalog.withColumn("word", F.explode(F.array_distinct("p_all")))
        .groupBy("brand_id", "word", "main", "sub")
        .agg(F.min("pos").alias("pos"))
    )
    return (
        keys.select("brand_id", "t_key", F.explode(reach).alias("word"))
        .join(index, ["brand_id", "word"])
        .groupBy("brand_id", "t_key", "main", "sub")
        .agg(F.min("pos").alias("first_pos"))
    )


def _word_pairs(keys, catalog, synonyms):
    """Pairs that can score at least one half with a shared word.

    A score of one half needs ``ceil(n / 2)`` of the n target words (a quarter when one word has
    synonyms, one word when several do), so one of the ``n - needed + 1`` rarest target words must
    be shared. Only those are joined. A catalog key with repeated words counts them twice, so all
    target words are tried against it. Longer catalog keys than the score allows are left out.
    """
    side = F.size("t_nouns")  # a repeated noun counts each time
    share = F.when(side == 0, 0.5).when(side == 1, 0.25).otherwise(0.0)
    in_catalog = (
        catalog.withColumn("word", F.explode(F.array_distinct("p_words")))
        .withColumn("m", F.size("p_words"))
        .withColumn("repeats", F.col("m") > F.size(F.array_distinct("p_words")))
    )
    frequency = in_catalog.groupBy("brand_id", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        keys.select("brand_id", "t_key", F.size("t_words").alias("n"), share.alias("share"), F.explode("t_words").alias("word"))
        .join(frequency, ["brand_id", "word"], "left")
        .groupBy("brand_id", "t_key", "n", "share")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("words"))
    )
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share"))).cast("int")
    probes = (
        ranked.withColumn("prefix", F.col("n") - needed + 1)
        .select("brand_id", "t_key", "n", "share", "prefix", F.posexplode("words").alias("at", "w"))
        .where("w.df > 0")
        .select("brand_id", "t_key", "n", "share", "prefix", "at", F.col("w.word").alias("word"))
    )
    fits = (F.col("share") == 0) | (F.col("m") * F.col("share") <= F.col("n"))
    pairs = (
        probes.join(in_catalog.select("brand_id", "word", "p_key", "m", "repeats").distinct(), ["brand_id", "word"])
        .where(F.col("repeats") | ((F.col("at") < F.col("prefix")) & fits))
        .select("brand_id", "t_key", "p_key")
        .distinct()
    )
    return pairs.join(catalog, ["brand_id", "p_key"])


def _synonym_only(keys, catalog, synonyms):
    """Targets with several furniture nouns can reach one half on synonyms alone.

    That part of the score depends only on which nouns and synonyms occur, so both sides reduce to
    the sets of those words (subsets of a fixed vocabulary) before they meet.
    """
    table = _synonym_map(synonyms)
    known = F.array(*[F.lit(w) for w in sorted({w for k, v in synonyms.items() for w in (k, *v)})])
    wanted = keys.withColumn("t_set", F.array_sort("t_nouns")).where(F.size("t_set") > 1)
    have = (
        catalog.withColumn("p_set", F.array_sort(F.array_intersect("p_all", known)))
        .where(F.size("p_set") > 0)
        .groupBy("brand_id", "p_set", "main", "sub")
        .agg(F.min("pos").alias("pos"))
    )
    helped = F.filter(
        F.col("t_set"),
        lambda w: ~F.array_contains(F.col("p_set"), w) & F.arrays_overlap(F.try_element_at(table, w), F.col("p_set")),
    )
    # A set of nouns meets the word sets that hold one of their synonyms.
    reach = F.array_distinct(F.flatten(F.transform("t_set", lambda w: F.try_element_at(table, w))))
    asked = wanted.select("brand_id", "t_set").distinct().withColumn("word", F.explode(reach))
    meeting = asked.join(have.withColumn("word", F.explode("p_set")), ["brand_id", "word"]).drop("word").distinct()
    best = (
        meeting.withColumn("score", F.size(helped) * 0.25)
        .where("score >= 0.5")
        .groupBy("brand_id", "t_set", "main", "sub")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "pos")).cast(_BEST).alias("best"))
    )
    return wanted.join(best, ["brand_id", "t_set"]).select("brand_id", "t_key", "main", "sub", "best")


def match_keys(targets, products, synonyms=rules.SYNONYMS):
    """Outcome per distinct (brand_id, t_key, cat): pos of the product, stage and score (M1).

    Stage 1 equal keys; stage 2 one key contains the other; stage 3 a shared word or a synonym.
    A later stage is tried only when the earlier one has no candidate. Within stages 2 and 3 the
    candidates of the wanted category are preferred, then the best score of at least one half
    wins, the first product on ties.
    """
    wanted = targets.select(
        "brand_id",
        model_key("model").alias("t_key"),
        F.when(F.length("category") > 2, F.lower(F.trim("category"))).otherwise(F.lit("")).alias("cat"),
    ).where("t_key <> '' and brand_id is not null").distinct()
    wanted = settle(wanted, "targets")
    catalog = settle(_catalog(products), "catalog")
    keys = wanted.select("brand_id", "t_key").distinct()

    same = catalog.groupBy("brand_id", F.col("p_key").alias("t_key")).agg(F.min("pos").alias("pos"))
    exact = wanted.join(same, ["brand_id", "t_key"]).select(
        "brand_id", "t_key", "cat", "pos", F.lit(1).alias("stage"), F.lit(1.0).alias("score")
    )

    left = settle(_with_target_words(keys.join(same, ["brand_id", "t_key"], "left_anti"), synonyms), "keys")
    pairs = inside(left, catalog).unionByName(around(left, catalog))
    contained = settle(_best(pairs.join(left, ["brand_id", "t_key"]), synonyms), "contained")
    by_text = contained.withColumn("stage", F.lit(2))

    open_keys = settle(left.join(contained, ["brand_id", "t_key"], "left_anti"), "open")
    reachable = _word_candidates(open_keys, catalog, synonyms)
    scored = (
        _best(_word_pairs(open_keys, catalog, synonyms).join(open_keys, ["brand_id", "t_key"]), synonyms)
        .drop("first_pos")
        .unionByName(_synonym_only(open_keys, catalog, synonyms))
        .groupBy("brand_id", "t_key", "main", "sub")
        .agg(F.min("best").alias("best"))
    )
    by_word = reachable.join(scored, ["brand_id", "t_key", "main", "sub"], "left").withColumn("stage", F.lit(3))

    cat, main, sub = F.col("cat"), F.col("main"), F.col("sub")
    fits = main.contains(cat) | sub.contains(cat) | cat.contains(main) | cat.contains(sub)
    picked = (
        wanted.join(by_text.unionByName(by_word), ["brand_id", "t_key"])
        .withColumn("fits", fits)
        .groupBy("brand_id", "t_key", "cat", "stage")
        .agg(
            F.max("fits").alias("any_fits"),
            F.min(F.when(F.col("fits"), F.col("best"))).alias("best_fit"),
            F.min("best").alias("best_any"),
            F.min(F.when(F.col("fits"), F.col("first_pos"))).alias("first_fit"),
            F.min("first_pos").alias("first_any"),
        )
        .withColumn("best", F.when(F.col("any_fits"), F.col("best_fit")).otherwise(F.col("best_any")))
        .withColumn("free", F.size(_usable(F.split("t_key", " "))) == 0)
    )
    accepted = picked.where(F.col("free") | (F.col("best.neg") <= -0.5)).select(
        "brand_id",
        "t_key",
        "cat",
        F.when(F.col("free"), F.coalesce("first_fit", "first_any")).otherwise(F.col("best.pos")).alias("pos"),
        "stage",
        F.when(F.col("free"), F.lit(0.0)).otherwise(-F.col("best.neg")).alias("score"),
    )
    return exact.unionByName(accepted)


def match_models(targets, products, synonyms=rules.SYNONYMS):
    """Targets with the product they match, null where none does (M1).

    ``targets``: brand_id, model, category, anything else. Adds match_pos, match_stage, match_score.
    """
    outcome = match_keys(targets, products, synonyms).select(
        "brand_id",
        F.col("t_key").alias("_t"),
        F.col("cat").alias("_c"),
        F.col("pos").alias("match_pos"),
        F.col("stage").alias("match_stage"),
        F.round("score", 6).alias("match_score"),
    )
    return (
        targets.withColumn("_t", model_key("model"))
        .withColumn("_c", F.when(F.length("category") > 2, F.lower(F.trim("category"))).otherwise(F.lit("")))
        .join(outcome, ["brand_id", "_t", "_c"], "left")
        .drop("_t", "_c")
    )


def with_product(matched, products, columns):
    """Product columns of the match, prefixed with ``match_``."""
    side = products.select(
        "brand_id", F.col("pos").cast("bigint").alias("match_pos"), *[F.col(c).alias(f"match_{c}") for c in columns]
    )
    return matched.join(side, ["brand_id", "match_pos"], "left")


# --------------------------------------------------------------------------- M8, M9, M10


def match_once(rows, matcher, keys=("tier",)):
    """Match each distinct description (without its leading room) once and hand it to all rows (M8)."""
    keyed = rows.withColumn("clean_description", strip_room("description"))
    columns = [*keys, "clean_description"]
    outcome = matcher(keyed.select(*columns).distinct())
    return keyed.join(outcome, columns, "left")


def snap_to_catalog(matches, products, collapse=True):
    """Most expensive product whose key contains, or is contained in, the matched model (M9).

    ``matches``: brand_id, model. Adds snap_pos; null when nothing matches.
    """
    price = F.coalesce(parse_number("price"), F.lit(0))
    catalog = (
        products.select("brand_id", model_key("model", collapse).alias("p_key"), price.alias("price"), F.col("pos").cast("bigint").alias("pos"))
        .groupBy("brand_id", "p_key")
        .agg(F.min(F.struct((-F.col("price")).alias("neg"), "pos")).alias("best"))
    )
    keyed = matches.withColumn("_t", model_key("model", collapse))
    keys = keyed.select("brand_id", F.col("_t").alias("t_key")).where("brand_id is not null").distinct()
    best = (
        inside(keys, catalog).unionByName(around(keys, catalog))
        .groupBy("brand_id", F.col("t_key").alias("_t"))
        .agg(F.min("best").alias("b"))
        .select("brand_id", "_t", F.col("b.pos").alias("snap_pos"))
    )
    return keyed.join(best, ["brand_id", "_t"], "left").drop("_t")


def fill_from_snap(snapped, products):
    """Categories, family, model, image, rate and description from the snapped product."""
    side = products.select(
        "brand_id",
        F.col("pos").cast("bigint").alias("snap_pos"),
        *[
            F.nullif(F.col(c), F.lit("")).alias(f"_{c}")
            for c in ("main_category", "sub_category", "model", "image_url", "product_url", "description")
        ],
        F.coalesce("family", F.lit("")).alias("_family"),
        parse_number("price").alias("_price"),
    )
    joined = snapped.join(side, ["brand_id", "snap_pos"], "left")
    hit = F.col("snap_pos").isNotNull()
    own = F.coalesce(parse_number("match_price"), F.lit(0))
    rate = F.when(F.col("_price") > 0, money("_price")).when(own > 0, money(own)).otherwise(
        money(F.coalesce(parse_number("rate"), F.lit(0)))
    )
    return joined.select(
        *[c for c in snapped.columns if c not in ("rate", "model")],
        F.coalesce("_main_category", "match_main_category", F.lit("Office Seating")).alias("selected_main_cat"),
        F.coalesce("_sub_category", "match_sub_category", F.lit("Staff Chairs")).alias("selected_sub_cat"),
        F.when(hit, F.col("_family")).otherwise(F.coalesce("match_family", F.lit(""))).alias("selected_family"),
        F.when(hit, F.coalesce("_model", F.lit(""))).otherwise(F.col("model")).alias("selected_model"),
        F.coalesce("_product_url", "_image_url").alias("selected_model_url"),
        F.coalesce("_description", "match_description", F.concat(F.lit("Model: "), "model")).alias("brand_desc"),
        rate.alias("rate"),
        money(rate * F.coalesce(parse_number("qty"), F.lit(0))).alias("amount"),
    )


def fill_prices(rows, products, brands):
    """Rows with a chosen product but no rate take its price; text only where there is none."""
    first = brands.groupBy(F.col("name").alias("selected_brand")).agg(F.min_by("brand_id", "brand_order").alias("brand_id"))
    # The first product of an address or a model brings its price and text along, so the catalog is met twice, not three times.
    product = F.struct("pos", parse_number("price").alias("price"), F.col("description").alias("text"))
    by_url = products.where(~blank("product_url")).groupBy("brand_id", F.col("product_url").alias("selected_model_url")).agg(F.min(product).alias("_by_url"))
    by_model = products.groupBy("brand_id", F.col("model").alias("selected_model")).agg(F.min(product).alias("_by_model"))
    found = (
        rows.join(first, "selected_brand", "left")
        .join(by_url, ["brand_id", "selected_model_url"], "left")
        .join(by_model, ["brand_id", "selected_model"], "left")
        .withColumn("_p", F.least("_by_url", "_by_model"))
        .withColumns({"_price": F.col("_p.price"), "_text": F.col("_p.text")})
    )
    current = F.when(blank(F.col("rate").cast("string")), F.lit(0).cast("decimal(18,4)")).otherwise(parse_number("rate"))
    chosen = ~blank("selected_brand") & ~blank("selected_model")
    update = F.coalesce(chosen & (F.col("_price") > 0) & (current == 0), F.lit(False))
    return found.select(
        *[c for c in rows.columns if c not in ("rate", "base_price", "brand_desc")],
        F.when(update, money("_price")).otherwise(money(parse_number("rate"))).alias("rate"),
        F.when(update, F.col("_price")).otherwise(F.col("base_price")).alias("base_price"),
        F.when(update & blank("brand_desc") & ~blank("_text"), F.col("_text")).otherwise(F.col("brand_desc")).alias("brand_desc"),
    )
