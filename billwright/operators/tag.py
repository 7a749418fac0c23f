"""Catalog tags on distinct texts.

The category patterns are the dearest expressions of the library, and catalogs repeat their texts.
Each distinct text is tagged once and the tags join back.
"""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.tagging import category_of, features_of, seniority, size_of


def tag_products(products, text_cols=("model", "description"), taxonomy=rules.TAXONOMY):
    """Adds tag_main, tag_sub, tag_rank, tag_features, tag_width, tag_depth."""
    text = F.trim(F.concat_ws(" ", *text_cols))
    keyed = products.withColumn("_text", text)
    tagged = (
        keyed.select("_text").distinct()
        .withColumn("_c", category_of("_text", taxonomy))
        .withColumn("_s", size_of("_text"))
        .select(
            "_text",
            F.col("_c.main").alias("tag_main"),
            F.col("_c.sub").alias("tag_sub"),
            seniority("_text").alias("tag_rank"),
            features_of("_text").alias("tag_features"),
            F.col("_s.width").alias("tag_width"),
            F.col("_s.depth").alias("tag_depth"),
        )
    )
    return keyed.join(tagged, "_text", "left").drop("_text")
