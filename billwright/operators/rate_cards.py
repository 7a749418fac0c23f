"""Fit-out lines to a priced rate card (M6, M7).

The choice follows fixed rules: an item with the same text wins; otherwise the item that shares
the sub category (carpet texts always mean carpet tiles) and most materials. Both sides reduce to
signatures (sub category and material set), so copies of a line or of an item meet only once.
"""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import parse_number
from billwright.functions.tagging import categories_of
from billwright.functions.text import model_key

CARPET = "Carpet Tiles"
SOURCE = "internal-fitout-db"


def materials_of(text, materials=rules.FITOUT_MATERIALS):
    """Materials named in a text, in table order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(lower.contains(m), F.lit(m)) for m in materials]))


def line_groups(text, taxonomy=rules.TAXONOMY):
    """Sub categories of a line; any mention of carpet means carpet tiles only."""
    subs = F.array_distinct(F.transform(categories_of(text, taxonomy), lambda c: c["sub"]))
    return F.when(F.lower(F.coalesce(text, F.lit(""))).contains("carpet"), F.array(F.lit(CARPET))).otherwise(subs)


def match_rate_card(lines, card, taxonomy=rules.TAXONOMY, materials=rules.FITOUT_MATERIALS, brand="Fit-out"):
    """One card item per distinct (tier, description), or no_match (M6).

    ``lines``: tier, description. ``card``: tier, pos, main_category, sub_category, family, model,
    description, price. A tier without a card uses the mid card. Returns tier, description, status,
    match_* columns, match_score, and for matches the name under which the card's items are sold, the source and the identified model.
    """
    present = card.groupBy("tier").agg(F.lit(True).alias("_has"))
    wanted = (
        lines.select("tier", "description").distinct()
        .join(present, "tier", "left")
        .withColumn("card_tier", F.when(F.col("_has"), F.col("tier")).otherwise(F.lit("mid")))
        .withColumn("t_key", model_key("description"))
        .withColumn("groups", line_groups(F.col("description"), taxonomy))
        .withColumn("parts", materials_of(F.col("description"), materials))
        .drop("_has")
    )
    items = card.select(
        F.col("tier").alias("card_tier"),
        F.col("pos").cast("bigint").alias("pos"),
        "sub_category",
        model_key("description").alias("text_key"),
        model_key("model").alias("model_key"),
        materials_of(F.concat_ws(" ", "description", "sub_category"), materials).alias("item_parts"),
    )
    same_text = (
        items.select("card_tier", F.explode(F.array("text_key", "model_key")).alias("t_key"), "pos")
        .where("t_key <> ''")
        .groupBy("card_tier", "t_key")
        .agg(F.min("pos").alias("exact_pos"))
    )
    signatures = items.groupBy("card_tier", "sub_category", "item_parts").agg(F.min("pos").alias("pos"))
    shapes = wanted.select("card_tier", "groups", "parts").distinct()
    hooks = lambda group, parts: F.concat(
        F.transform(group, lambda g: F.concat(F.lit("group:"), g)),
        F.transform(parts, lambda m: F.concat(F.lit("part:"), m)),
    )
    left = shapes.withColumn("hook", F.explode(hooks(F.col("groups"), F.col("parts"))))
    right = signatures.withColumn(
        "hook", F.explode(hooks(F.array("sub_category"), F.col("item_parts")))
    )
    shared = F.size(F.array_intersect("parts", "item_parts"))
    score = F.when(F.array_contains("groups", F.col("sub_category")), 2).otherwise(0) + shared
    scored = (
        left.join(right, ["card_tier", "hook"])
        .withColumn("score", score)
        .groupBy("card_tier", "groups", "parts")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "pos")).alias("best"))
    )
    chosen = (
        wanted.join(same_text, ["card_tier", "t_key"], "left")
        .join(scored, ["card_tier", "groups", "parts"], "left")
        .withColumn("match_pos", F.coalesce("exact_pos", "best.pos"))
        .withColumn(
            "match_score",
            F.when(F.col("exact_pos").isNotNull(), F.lit(1.0)).otherwise(
                F.round(-F.col("best.neg") / (F.lit(2.0) + F.greatest(F.size("parts"), F.lit(1))), 6)
            ),
        )
    )
    details = card.select(
        F.col("tier").alias("card_tier"),
        F.col("pos").cast("bigint").alias("match_pos"),
        *[F.col(c).alias(f"match_{c}") for c in ("main_category", "sub_category", "family", "model", "description")],
        parse_number("price").alias("match_price"),
    )
    return chosen.join(details, ["card_tier", "match_pos"], "left").select(
        "tier",
        "description",
        "card_tier",
        F.when(F.col("match_pos").isNull(), F.lit("no_match")).otherwise(F.lit("success")).alias("status"),
        "match_pos",
        "match_main_category",
        "match_sub_category",
        "match_family",
        "match_model",
        "match_description",
        "match_price",
        "match_score",
        F.when(F.col("match_pos").isNotNull(), F.lit(brand)).alias("match_brand"),
        F.when(F.col("match_pos").isNotNull(), F.lit(SOURCE)).alias("source"),
        F.when(F.col("match_pos").isNotNull(), F.col("match_model")).alias("identified_model"),
    )


def match_batch(items, card, **tables):
    """Every item with its match and a status; items without text are errors (M7)."""
    text = F.trim(F.coalesce("description", F.lit("")))
    found = match_rate_card(items.where(text != ""), card, **tables)
    joined = items.join(found, ["tier", "description"], "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("error")))
