"""Cascading catalog choices and variants.

Products: brand_id, pos, norm_category, norm_sub_category, main_category, sub_category, family,
model, description, image_url, product_url, price.
"""

from pyspark.sql import functions as F

from billwright.functions.numbers import blank, money, or_else, parse_number
from billwright.functions.urls import option_value
from billwright.operators.ordering import first_row, number_rows

_HIDDEN = ["null", "undefined"]


def _levels(products):
    """Categories as the choices see them: the normalized one, else the raw one."""
    return products.withColumn("_main", or_else("norm_category", "main_category")).withColumn(
        "_sub", or_else("norm_sub_category", "sub_category")
    )


def cascade_options(products):
    """Every option of every level under its parents, one row each.

    Main and sub categories merge normalized and raw values; families and below use the effective
    parents. Sort by option to show them.
    """
    p = _levels(products)
    none = F.lit("")

    def level(name, parents, values):
        options = p.select(
            "brand_id",
            F.lit(name).alias("level"),
            (F.coalesce("_main", none) if parents > 0 else none).alias("main"),
            (F.coalesce("_sub", none) if parents > 1 else none).alias("sub"),
            F.explode(F.array(*values)).alias("option"),
        )
        return options.where(~blank("option") & ~F.col("option").isin(_HIDDEN))

    mains = level("main", 0, ["norm_category", "main_category"])
    subs = level("sub", 1, ["norm_sub_category", "sub_category"])
    families = level("family", 2, ["family"])
    return mains.unionByName(subs).unionByName(families).distinct()


def _single(products):
    """The option of each level that has exactly one."""
    return (
        cascade_options(products)
        .groupBy("brand_id", "level", "main", "sub")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("option").alias("only"))
        .where("_n = 1")
        .drop("_n")
    )


def variants(products):
    """Products without repeats of the same page, image or id inside one choice, first one kept."""
    p = _levels(products).withColumn("family", F.coalesce("family", F.lit("")))
    p = p.withColumn("uid", option_value("product_url", "image_url", F.concat(F.lit("id_"), F.col("pos").cast("string"))))
    return first_row(p, ["brand_id", "_main", "_sub", "family", "uid"], ["pos"])


def variant_options(products, block=None):
    """Label and value of each variant; a text snippet only where several share the model."""
    group = ["brand_id", "_main", "_sub", "family", "model"]
    one = variants(products).withColumn("model", F.coalesce("model", F.lit("")))
    one = one.withColumn("_main", F.coalesce("_main", F.lit(""))).withColumn("_sub", F.coalesce("_sub", F.lit("")))
    numbered = number_rows(one, group, ["pos"], "_i", F.floor(F.col("pos") / 65536) if block is None else block)
    sizes = one.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    label = F.concat(F.lit("["), or_else("sub_category", "main_category", F.lit("Misc")), F.lit("] "), "model")
    snippet = F.when(~blank("description"), F.concat(F.substring("description", 1, 25), F.lit("..."))).otherwise(
        F.concat(F.lit("Variant "), F.col("_i").cast("string"))
    )
    made_up = F.concat(F.lit("model_"), "model", F.lit("_"), (F.col("_i") - 1).cast("string"))
    return numbered.join(sizes, group).select(
        "brand_id",
        "pos",
        F.col("_main").alias("main"),
        F.col("_sub").alias("sub"),
        "family",
        "model",
        option_value("product_url", "image_url", made_up).alias("value"),
        F.when(F.col("_n") > 1, F.concat(label, F.lit(" ("), snippet, F.lit(")"))).otherwise(label).alias("label"),
    )


def auto_select(rows, products):
    """Fill single options down the levels; a single variant also fills price and amount."""
    single = _single(products)

    def fill(df, level, column, parents):
        side = single.where(F.col("level") == level).select(
            "brand_id", *[F.col(o).alias(c) for o, c in parents], F.col("only").alias("_only")
        )
        ready = F.lit(True)
        for _, c in parents:
            ready = ready & ~blank(c)
        joined = df.join(side, ["brand_id", *[c for _, c in parents]], "left")
        value = F.when(blank(column) & ready, F.coalesce("_only", column)).otherwise(F.col(column))
        return joined.withColumn(column, value).drop("_only")

    out = fill(rows, "main", "selected_main_cat", [])
    out = fill(out, "sub", "selected_sub_cat", [("main", "selected_main_cat")])
    out = fill(out, "family", "selected_family", [("main", "selected_main_cat"), ("sub", "selected_sub_cat")])
    keys = ["brand_id", "selected_main_cat", "selected_sub_cat", "selected_family"]
    lone = (
        variants(products)
        .select(
            "brand_id",
            F.col("_main").alias("selected_main_cat"),
            F.col("_sub").alias("selected_sub_cat"),
            F.col("family").alias("selected_family"),
            F.struct("model", "product_url", "image_url", "description", "price", "pos").alias("v"),
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by("v", F.col("v.pos")).alias("_v"))
        .where("_n = 1")
        .drop("_n")
    )
    joined = out.join(lone, keys, "left")
    take = F.coalesce(blank("selected_model") & ~blank("selected_family") & F.col("_v").isNotNull(), F.lit(False))
    price, qty = F.coalesce(parse_number("_v.price"), F.lit(0)), F.coalesce(parse_number("qty"), F.lit(0))
    made_up = F.concat(F.lit("model_"), F.col("_v.model"), F.lit("_0"))
    return joined.select(
        *[c for c in rows.columns if c not in ("selected_model", "selected_model_url", "rate", "amount", "unit")],
        F.when(take, F.col("_v.model")).otherwise(F.col("selected_model")).alias("selected_model"),
        F.when(take, option_value("_v.product_url", "_v.image_url", made_up)).otherwise(F.col("selected_model_url")).alias("selected_model_url"),
        F.when(take & (price > 0), money(price)).otherwise(money(parse_number("rate"))).alias("rate"),
        F.when(take & (price > 0) & (qty > 0), money(price * qty)).otherwise(money(parse_number("amount"))).alias("amount"),
        F.when(take & blank("unit"), F.lit("Nos")).otherwise(F.col("unit")).alias("unit"),
    )


def lookup_variant(selections, products, block=None):
    """Product behind a chosen value: by page or image address, else by hierarchy, model and index."""
    p = _levels(products)
    by_url = (
        p.select("brand_id", F.explode(F.array("product_url", "image_url")).alias("value"), "pos")
        .where(~blank("value"))
        .groupBy("brand_id", "value")
        .agg(F.min("pos").alias("_url_pos"))
    )
    group = ["brand_id", "main", "sub", "family", "model"]
    tree = p.select("brand_id", F.col("_main").alias("main"), F.col("_sub").alias("sub"), "family", "model", "pos").dropna(subset=group)
    numbered = number_rows(tree, group, ["pos"], "_i", F.floor(F.col("pos") / 65536) if block is None else block)
    parts = F.split("value", "_")
    index = F.when(
        F.col("value").startswith("model_") & (F.size(parts) >= 3), F.element_at(parts, -1).try_cast("int")
    )
    firsts = tree.groupBy(*group).agg(F.min("pos").alias("_first_pos"))
    return (
        selections.withColumn("_i", F.coalesce(index, F.lit(0)) + 1)
        .join(by_url, ["brand_id", "value"], "left")
        .join(numbered.withColumnRenamed("pos", "_tree_pos"), [*group, "_i"], "left")
        .join(firsts, group, "left")
        .withColumn("product_pos", F.coalesce("_url_pos", "_tree_pos", "_first_pos"))
        .drop("_i", "_url_pos", "_tree_pos", "_first_pos")
    )
