"""First-wins and category-priority deduplication of harvested products."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.urls import is_product_image
from billwright.operators.ordering import first_row


def _joined(*cols):
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def unique_products(products, rule, scope=("harvest_id",)):
    """First product per key, in harvest order.

    Rules: 'model_image' (without case, valid image only), 'model_url' (without case),
    'model_image_exact' (with case), 'title' (per page, without case).
    """
    scope = list(scope)
    if rule == "model_image":
        keyed = products.where(is_product_image("image_url")).withColumn("_k", F.lower(_joined("model", "image_url")))
    elif rule == "model_url":
        keyed = products.withColumn("_k", F.lower(_joined("model", "product_url")))
    elif rule == "model_image_exact":
        keyed = products.withColumn("_k", _joined("model", "image_url"))
    elif rule == "title":
        scope = [*scope, "page_id"]
        keyed = products.withColumn("_k", F.lower(F.coalesce("model", F.lit(""))))
    else:
        raise ValueError(f"unknown rule {rule}")
    return first_row(keyed, [*scope, "_k"], ["pos"]).drop("_k")


def prefer_specific(products, scope=("harvest_id",), generic=tuple(rules.GENERIC_CATEGORIES)):
    """One product per address, exactly as a pairwise replay in harvest order would choose.

    A new product replaces the kept one when it is specific (main and sub category differ) and the
    kept one is not, or when its main category is not generic and the kept one's is. So a specific,
    non-generic product is final; a flat, generic one never replaces anything; and the two mixed
    kinds replace each other. The winner follows from the positions of the kinds, which plain
    aggregates deliver: the first final product if any, else the first product of the last run of
    one mixed kind, else the first product.
    """
    key = [*scope, "_u"]
    keyed = products.where(is_product_image("image_url", rules.UI_IMAGE_WORDS)).withColumn(
        "_u", F.lower(F.coalesce("product_url", F.lit("")))
    )
    specific = F.coalesce(F.col("main_category"), F.lit("")) != F.coalesce(F.col("sub_category"), F.lit(""))
    is_generic = F.lower(F.coalesce("main_category", F.lit(""))).isin(list(generic))
    kind = (
        F.when(specific & ~is_generic, "final")
        .when(specific, "specific")
        .when(~is_generic, "named")
        .otherwise("plain")
    )
    keyed = keyed.withColumn("_kind", kind)

    def edge(f, name):
        return f(F.when(F.col("_kind") == name, F.col("pos")))

    edges = keyed.groupBy(*key).agg(
        edge(F.min, "final").alias("_final"),
        edge(F.max, "specific").alias("_last_specific"),
        edge(F.max, "named").alias("_last_named"),
        F.min("pos").alias("_first"),
    )
    last_s, last_n = F.coalesce("_last_specific", F.lit(-1)), F.coalesce("_last_named", F.lit(-1))
    run_kind = F.when(last_s > last_n, "specific").otherwise("named")
    after = F.when(last_s > last_n, last_n).otherwise(last_s)
    mixed = F.col("_last_specific").isNotNull() | F.col("_last_named").isNotNull()
    eligible = (
        F.when(F.col("_final").isNotNull(), F.col("pos") == F.col("_final"))
        .when(mixed, (F.col("_kind") == run_kind) & (F.col("pos") > after))
        .otherwise(F.col("pos") == F.col("_first"))
    )
    return first_row(keyed.join(edges, key).where(eligible), key, ["pos"]).drop(
        "_u", "_kind", "_final", "_last_specific", "_last_named", "_first"
    )
