"""Stored pages to deduplicated products of each site."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.urls import origin
from billwright.operators import dedup, harvest
from billwright.operators.settle import settle
from billwright.sources.pages import page_elements


def harvest_pages(pages):
    """Cards, generic blocks and declared products of all pages; the first product per site, model and image wins.

    ``harvest_id`` is the site. First means: by page, then cards and blocks before declared
    products, then place on the page (script, item and entry of declared ones).
    """
    elements = settle(page_elements(pages), "elements")
    return dedup.unique_products(found_products(elements, pages), "model_image")


def found_products(elements, pages):
    """Products of all pages with their place, brand and site, repeats included."""
    cards = settle(harvest.page_cards(elements, title_length=rules.CARD_TITLE_LENGTH), "cards")
    blocks = harvest.page_blocks(elements, cards, rules.FEW_CARDS, rules.BLOCK_TITLE_LEAST)
    declared = harvest.structured_products(pages).select(
        "page_id",
        F.struct(F.lit(1).alias("part"), F.col("script_no").cast("long").alias("a"), F.col("item_no").cast("long").alias("b"), F.col("entry_no").cast("long").alias("c")).alias("pos"),
        F.lit("Products").alias("main_category"),
        F.lit("General").alias("sub_category"),
        "model",
        F.col("model").alias("description"),
        "image_url",
        "product_url",
        F.lit(0).cast("decimal(18,4)").alias("price"),
    )
    # A card and a block may be the same element, so the last number tells them apart.
    placed = lambda kind: F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(kind).cast("long").alias("c"))
    found = cards.withColumn("pos", placed(0)).unionByName(blocks.withColumn("pos", placed(1))).unionByName(declared)
    brand = harvest.brand_info(elements).select("page_id", F.col("name").alias("brand"), F.col("url").alias("page_url"))
    joined = found.join(brand, "page_id").withColumn("family", F.col("brand")).withColumn("harvest_id", origin("page_url"))
    return joined.withColumn("pos", F.struct("page_id", "pos.*"))


def harvest_sites(pages, stamped_at, tiers=None, by_address=True):
    """Stored pages to what a harvest delivers per site: products with enriched descriptions, brand records, summary.

    Listed products and those of detail pages are made unique, take the better description of their own page where
    it is stored, and are made unique once more by model and address; with ``by_address=False`` a product listed with two images stays twice. The brand of a site is the one its first page names; its
    logo is the best-scored of any page. ``tiers`` (harvest_id, tier) names the tier of a site.
    """
    elements = settle(page_elements(pages), "elements")
    listed = found_products(elements, pages)
    urls = pages.select("page_id", origin("url").alias("harvest_id"), F.col("url").alias("page_url"))
    place = F.struct("page_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    own = harvest.page_details(elements).join(urls, "page_id").withColumn("pos", place).withColumn("price", F.lit(0).cast("decimal(18,4)"))
    names = harvest.brand_info(elements).select("page_id", "name", origin("url").alias("harvest_id"))
    brands = settle(names.groupBy("harvest_id").agg(F.min_by("name", "page_id").alias("brand")), "brands")
    found = listed.drop("brand", "family").unionByName(own).join(brands, "harvest_id").withColumn("family", F.col("brand"))
    unique = settle(dedup.unique_products(found, "model_image").withColumn("product_id", F.col("pos")), "unique")
    texts = harvest.page_texts(elements)
    better = settle(harvest.enrich_descriptions(unique, texts, pages, rules.TEXT_LENGTH, rules.META_LENGTH), "enriched")
    products = (dedup.unique_products(better, "model_url") if by_address else better).drop("product_id")
    logos = harvest.logo_of(elements, names).join(urls, "page_id")
    best = logos.groupBy("harvest_id").agg(F.max_by("logo", F.struct("score", -F.col("page_id"))).alias("logo"))
    known = brands.join(best, "harvest_id", "left")
    known = known.withColumn("tier", F.lit(None).cast("string")) if tiers is None else known.join(tiers, "harvest_id", "left")
    summary = better.groupBy("harvest_id").agg(
        F.count(F.lit(1)).alias("total_found"),
        F.count_if("enriched").alias("enriched"),
        F.count_if("failed").alias("failed_enrichment"),
    ).join(products.groupBy("harvest_id").agg(F.count(F.lit(1)).alias("unique")), "harvest_id")
    return {"products": products, "brands": harvest.brand_records(products, known, stamped_at), "summary": summary}
