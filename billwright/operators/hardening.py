"""Discoveries into the catalog, match outcomes and history."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import or_else, parse_number
from billwright.functions.tagging import snap_category
from billwright.functions.text import model_key, name_key
from billwright.operators.ordering import first_row, number_rows

SOURCE = "AI-Specialist-Discovery"


def shape_discoveries(details, taxonomy=rules.TAXONOMY):
    """Catalog columns with defaults for discovered products."""
    pair = snap_category("main_category", "sub_category", taxonomy)
    asked = F.col("asked_model")
    return details.select(
        "brand",
        *[c for c in ("tier", "seq") if c in details.columns],
        or_else("model", asked).alias("model"),
        or_else("family", "model", asked).alias("family"),
        or_else(
            "description", F.concat(F.lit("Official "), "brand", F.lit(" "), asked, F.lit(" extracted via AI Discovery."))
        ).alias("description"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.coalesce("website_url", F.lit("")).alias("website_url"),
        pair["main"].alias("main_category"),
        pair["sub"].alias("sub_category"),
        F.coalesce(parse_number("price"), F.lit(0)).alias("price"),
        F.lit("USD").alias("currency"),
        F.lit("AI-Enrichment").alias("source"),
    )


def new_products(discoveries, catalog):
    """Discoveries whose model is not in the catalog of their brand and tier, first one of each."""
    key = [name_key("brand").alias("_b"), F.coalesce(F.nullif(F.lower("tier"), F.lit("")), F.lit("mid")).alias("_t"), name_key("model").alias("_m")]
    have = catalog.select(*key).distinct()
    fresh = discoveries.select("*", *key)
    return (
        first_row(fresh, ["_b", "_t", "_m"], ["seq"])
        .join(have, ["_b", "_t", "_m"], "left_anti")
        .drop("_b", "_t", "_m")
    )


def harden(discoveries, catalog, brands, stamped_at, on_unknown="reject", block=None):
    """Catalog rows to append: new products of known brands behind the existing ones.

    ``discoveries``: brand, tier, seq (arrival order), model, …; helper fields are not carried over.
    ``on_unknown='create'`` keeps brands the catalog has never seen, as the match routes do.
    """
    fresh = new_products(discoveries, catalog)
    tier = F.coalesce(F.nullif(F.lower("tier"), F.lit("")), F.lit("mid"))
    known = brands.groupBy(name_key("name").alias("_b"), tier.alias("_t")).agg(F.min_by("brand_id", "brand_order").alias("brand_id"))
    placed = fresh.withColumn("_b", name_key("brand")).withColumn("_t", tier).join(known, ["_b", "_t"], "left")
    if on_unknown == "reject":
        placed = placed.where("brand_id is not null")
    else:
        placed = placed.withColumn(
            "brand_id", F.coalesce("brand_id", F.concat(F.col("_b"), F.lit("-"), F.col("_t")))
        )
    last = catalog.groupBy("brand_id").agg(F.max("pos").alias("_last"))
    ordinal = number_rows(
        placed, ["brand_id"], ["seq"], "_n", F.floor(F.col("seq") / 65536) if block is None else block
    )
    return (
        ordinal.join(last, "brand_id", "left")
        .withColumn("pos", F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_n"))
        .withColumn("last_updated", F.lit(stamped_at).cast("timestamp"))
        .withColumn("source", F.lit(SOURCE))
        .drop("_b", "_t", "_n", "_last", "seq", *[c for c in ("status", "logic", "error_message") if c in placed.columns])
    )


def outcome_counts(results, no_match_is_error=False):
    """Success, error and newly added lines per tier.

    ``no_match_is_error`` is the rule of the fit-out and value-engineering flows.
    """
    bad = ["error", "no_match"] if no_match_is_error else ["error"]
    return results.groupBy("tier").agg(
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status").isin(bad)).alias("error"),
        F.count_if(F.coalesce(F.col("source") == "ai-discovery-hardened", F.lit(False))).alias("newly_added"),
    )


def match_history(matches):
    """How often each product was chosen for a description."""
    return matches.groupBy("description", "brand", "model").agg(F.count(F.lit(1)).alias("times"))


def usual_match(history):
    """The product chosen most often per description; brand and model break ties."""
    best = F.min_by(F.struct("brand", "model", "times"), F.struct(-F.col("times"), "brand", "model"))
    return history.groupBy("description").agg(best.alias("m")).select("description", "m.*")


def remembered(lines, history):
    """Lines with the product the history suggests."""
    usual = usual_match(history).select(
        model_key("description").alias("_k"), F.col("brand").alias("usual_brand"), F.col("model").alias("usual_model"), "times"
    )
    one = usual.groupBy("_k").agg(F.max_by(F.struct("usual_brand", "usual_model", "times"), F.struct("times", "usual_brand", "usual_model")).alias("u"))
    return lines.withColumn("_k", model_key("description")).join(one, "_k", "left").select(
        *lines.columns, "u.usual_brand", "u.usual_model", "u.times"
    )
