"""Value engineering: one brand per line, tier ignored."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import or_else, parse_number
from billwright.functions.tagging import bucket_of
from billwright.functions.text import model_key, name_key
from billwright.functions.urls import image_or_logo
from billwright.operators.matching import match_models, resolve_brands, with_product


def route(rows, assignment=None, global_brand=None, buckets=rules.BUCKETS):
    """Target brand and category scope of each line; lines without a brand are left out.

    ``assignment``: bucket -> brand (a handful of entries). Unknown buckets go to the desking brand
    without a scope.
    """
    if global_brand is not None:
        routed = rows.withColumn("target_brand", F.lit(global_brand)).withColumn(
            "category_scope", F.lit(None).cast("string")
        )
    else:
        assignment = assignment or {name: brand for name, _, brand, _ in buckets}
        bucket = bucket_of("description", buckets)
        brand, label = F.lit(assignment.get("desking", "")), F.lit(None).cast("string")
        for name, title, _, _ in buckets:
            brand = F.when(bucket == name, F.lit(assignment.get(name, ""))).otherwise(brand)
            label = F.when(bucket == name, F.lit(title)).otherwise(label)
        routed = rows.withColumn("target_brand", brand).withColumn("category_scope", label)
    return routed.where("target_brand <> ''")


def match_lines(lines, brands, products, details):
    """Catalog hit, else discovered details, else the bare identity.

    ``lines``: target_brand, category_scope, status, brand, model, main_category, logic plus keys.
    ``details``: brand, model, description, image_url, price, sub_category. Lines that were not
    identified are no_match.
    """
    identified = (F.col("status") == "success") & (F.trim(F.coalesce("model", F.lit(""))) != "")
    asked = (
        lines.withColumn("_ok", F.coalesce(identified, F.lit(False)))
        .withColumn("model", F.trim("model"))
        .withColumn("found_brand", or_else("brand", "target_brand"))
        .withColumn("category", F.coalesce(F.nullif("main_category", F.lit("")), F.nullif("category_scope", F.lit("")), F.lit("")))
    )
    local = resolve_brands(asked, brands, "target_brand", None)
    hits = with_product(
        match_models(local, products),
        products,
        ["model", "main_category", "sub_category", "description", "image_url", "price"],
    )
    known = details.groupBy(name_key("brand").alias("_b"), model_key("model").alias("_m")).agg(
        F.min(F.struct("model", "description", "image_url", "price", "sub_category")).alias("_d")
    )
    joined = (
        hits.withColumn("_b", name_key("found_brand"))
        .withColumn("_m", model_key("model"))
        .join(known, ["_b", "_m"], "left")
    )
    local_hit, detail = F.col("match_pos").isNotNull(), F.col("_d").isNotNull()

    def pick(from_catalog, from_detail, bare):
        return F.when(~F.col("_ok"), F.lit(None)).when(local_hit, from_catalog).when(detail, from_detail).otherwise(bare)

    logo = F.coalesce("brand_logo", F.lit(""))
    return joined.select(
        *[c for c in lines.columns if c not in ("status", "brand", "model", "main_category")],
        F.when(F.col("_ok"), F.lit("success")).otherwise(F.lit("no_match")).alias("status"),
        pick(F.lit("local-database"), F.lit("ve-ai-discovery"), F.lit("ve-identity-only")).alias("source"),
        F.when(F.col("_ok"), F.col("found_brand")).alias("brand"),
        pick(F.col("match_model"), or_else("_d.model", "model"), F.col("model")).alias("model"),
        pick(or_else("match_main_category", "category"), F.col("category"), F.col("category")).alias("main_category"),
        pick(F.coalesce("match_image_url", F.lit("")), image_or_logo("_d.image_url", "brand_logo"), logo).alias("image_url"),
        pick(
            F.coalesce(parse_number("match_price"), F.lit(0)),
            F.coalesce(parse_number("_d.price"), F.lit(0)),
            F.lit(0).cast("decimal(18,4)"),
        ).alias("price"),
        pick(F.col("match_description"), F.col("_d.description"), F.coalesce("logic", F.lit(""))).alias("match_description"),
    )
