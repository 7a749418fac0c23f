"""Line items to catalog products per tier."""

from decimal import Decimal

from pyspark.sql import functions as F

from billwright.functions.numbers import or_else, parse_number
from billwright.functions.text import model_key, name_key
from billwright.functions.urls import image_or_logo
from billwright.operators import hardening, matching
from billwright.operators.ordering import first_row
from billwright.operators.settle import settle

#: Above every number that ``monotonically_increasing_id`` gives.
_IDS = Decimal(10) ** 19


def auto_match(candidates, identified, brands, products, discovered):
    """One result per line (doc_id, sn, description, qty, rate) and tier.

    ``candidates``: doc_id, sn, tier, candidate_brand, candidate_order, description, qty, rate.
    ``identified``: candidate_brand, description, status, brand, model, main_category.
    ``discovered``: brand, model, main_category, image_url, price, description.
    """
    # What a candidate finds depends on its brand, tier and description alone: each of these is asked once, lines only look up the outcome.
    name = ["candidate_brand", "tier", "description"]
    asked = matching.isolate_tiers(candidates.select(*name).distinct(), brands).join(identified, ["candidate_brand", "description"])
    valid = asked.where((F.col("status") == "success") & ~F.coalesce("model", F.lit("")).isin("", "FAILED")).select(
        *name,
        or_else("brand", "candidate_brand").alias("brand"),
        F.trim("model").alias("model"),
        F.coalesce("main_category", F.lit("")).alias("category"),
    )
    resolved = settle(matching.resolve_brands(valid, brands), "asked")
    columns = ["model", "main_category", "sub_category", "family", "description", "price"]
    local = matching.with_product(matching.match_models(resolved, products), products, columns)
    details = discovered.groupBy(name_key("brand").alias("_b"), model_key("model").alias("_m")).agg(
        F.min(F.struct("model", "main_category", "image_url", "price", "description")).alias("d")
    )
    tried = (
        local.withColumn("_b", name_key("brand")).withColumn("_m", model_key("model")).join(details, ["_b", "_m"], "left")
    )
    hit = F.col("match_pos").isNotNull()
    found = tried.where(hit | F.col("d").isNotNull()).select(
        *name, "brand", "brand_id", "brand_logo",
        F.when(hit, 0).otherwise(1).alias("source_rank"),
        F.when(hit, "local-database").otherwise("ai-discovery-hardened").alias("source"),
        F.when(hit, F.col("match_model")).otherwise(F.col("d.model")).alias("model"),
        F.when(hit, F.col("match_main_category")).otherwise(or_else("d.main_category", "category", F.lit("Furniture"))).alias("match_main_category"),
        F.when(hit, F.col("match_sub_category")).alias("match_sub_category"),
        F.when(hit, F.col("match_family")).alias("match_family"),
        F.when(hit, F.col("match_description")).otherwise(F.col("d.description")).alias("match_description"),
        F.when(hit, parse_number("match_price")).otherwise(parse_number("d.price")).alias("match_price"),
        F.when(~hit, image_or_logo("d.image_url", "brand_logo")).alias("discovered_image"),
    )
    outcomes = settle(first_row(found, name, ["source_rank", "brand", "model"]).withColumn("_id", F.monotonically_increasing_id()), "outcomes")
    # Brand order first, then catalog before discovery (M5), as one number that ends in the outcome's.
    place = (F.col("candidate_order") * 2 + F.col("source_rank")).cast("decimal(11,0)") * F.lit(_IDS) + F.col("_id").cast("decimal(19,0)")
    tried_lines = candidates.join(outcomes.select(*name, "source_rank", "_id"), name, "left")
    lines = tried_lines.groupBy("doc_id", "sn", "tier", "description", "qty", "rate").agg(F.min(place).alias("_place"))
    best = outcomes.drop("candidate_brand", "tier", "description", "source_rank")
    results = lines.withColumn("_id", (F.col("_place") % F.lit(_IDS)).cast("bigint")).drop("_place").join(best, "_id", "left").drop("_id")
    return results.withColumn("status", F.when(F.col("source").isNull(), "no_match").otherwise("success"))


def snap_results(results, products):
    """Successful results filled from the catalog: rate, amount, categories."""
    won = settle(results.where("status = 'success'"), "results")
    return matching.fill_from_snap(matching.snap_to_catalog(won, products), products)


def outcome(results):
    return hardening.outcome_counts(results)
