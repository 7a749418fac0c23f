"""Registers, counts and listings."""

from pyspark.sql import functions as F

from billwright.functions.numbers import AMOUNT, or_else, parse_number
from billwright.functions.tagging import is_kept_product, tier_of
from billwright.functions.text import name_key, tidy
from billwright.operators.ordering import first_rows, number_rows
from billwright.operators.sheets import ROW_BLOCK, role_value


def _has_text():
    return F.exists(F.map_values("cells"), lambda v: v != "")


def _with_text(table, roles):
    rows = table.where(_has_text())
    return rows if roles is None else rows.join(roles, "doc_id")


def _plain_rows(table):
    for flag in ("is_header", "is_summary"):
        if flag in table.columns:
            table = table.where(~F.coalesce(F.col(flag), F.lit(False)))
    return table


def _numbered(rows, whole):
    block = None if whole else F.floor(F.col("row_idx") / ROW_BLOCK)
    return number_rows(rows, ["doc_id"], ["row_idx"], "item_no", block)


def delivery_register(table, roles=None, whole=False):
    """Delivered items: rows with a quantity above 0, numbered per document.

    Here and below, ``whole`` says that every document fits a task; without ``roles`` the table carries them.
    """
    qty = parse_number(role_value("qty"))
    rows = _with_text(_plain_rows(table), roles).withColumn("_qty", qty).where("_qty > 0")
    numbered = _numbered(rows, whole)

    def text(role, default):
        return F.when(F.col(f"{role}_col").isNull(), F.lit(default)).otherwise(role_value(role))

    return numbered.select(
        "doc_id",
        "item_no",
        text("description", "N/A").alias("description"),
        text("brand", "—").alias("brand"),
        text("unit", "No.").alias("unit"),
        F.col("_qty").cast(AMOUNT).alias("delivered_qty"),
    )


def inspection_register(table, roles, reference, whole=False):
    """Material or works inspection: running item number, title from code, number or count."""
    rows = _with_text(table, roles)
    numbered = _numbered(rows, whole)
    padded = F.lpad(F.col("item_no").cast("string"), 3, "0")
    label = F.when(F.col("item_no") > 999, F.col("item_no").cast("string")).otherwise(padded)
    title = or_else(F.trim(role_value("code")), F.trim(role_value("sn")), label)
    return numbered.select(
        "doc_id",
        "item_no",
        tidy(F.regexp_replace(title, r"\n+", ", ")).alias("title"),
        F.concat(F.lit(reference + "-"), label).alias("reference"),
        role_value("description").alias("description"),
        role_value("brand").alias("brand"),
        role_value("qty").alias("qty"),
        role_value("unit").alias("unit"),
    )


def approval_register(table, roles=None, whole=False):
    """Material approval: running item number padded to three, description, brand, quantity."""
    rows = _with_text(table, roles)
    numbered = _numbered(rows, whole)
    padded = F.lpad(F.col("item_no").cast("string"), 3, "0")
    return numbered.select(
        "doc_id",
        "item_no",
        F.when(F.col("item_no") > 999, F.col("item_no").cast("string")).otherwise(padded).alias("item"),
        *[role_value(r).alias(r) for r in ("description", "brand", "qty")],
    )


def line_counts(rows, keys=("doc_id",)):
    """All rows, rows that are neither header nor summary, rows with an offer."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    offered = (F.coalesce(F.col("brand_image"), F.lit("")) != "") | (F.coalesce(F.col("brand_desc"), F.lit("")) != "")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(~flag("is_header") & ~flag("is_summary")).alias("item_rows"),
        F.count_if(offered).alias("offered_rows"),
    )


def catalog_complexity(products, top=5):
    """Distinct sub categories + distinct families + products / 100, the highest first."""
    stats = products.groupBy("brand").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.count_distinct(F.coalesce("norm_sub_category", "sub_category")).alias("sub_categories"),
        F.count_distinct(F.coalesce("norm_category", "main_category")).alias("main_categories"),
        F.count_distinct("family").alias("families"),
    )
    score = F.col("sub_categories") + F.col("families") + F.col("product_count") / F.lit(100.0)
    return stats.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "brand").limit(top)


def harvest_counts(products):
    """Products by category and by sub category, and in total (A10)."""
    levels = F.array(
        F.struct(F.lit("total").alias("level"), F.lit("").alias("name")),
        F.struct(F.lit("category").alias("level"), F.col("main_category").alias("name")),
        F.struct(F.lit("sub_category").alias("level"), F.col("sub_category").alias("name")),
    )
    return (
        products.select("brand", F.explode(levels).alias("l"))
        .groupBy("brand", "l.level", "l.name")
        .agg(F.count(F.lit(1)).alias("products"))
    )


def harvest_sample(products, n=10):
    """First products of each harvest (A10)."""
    return first_rows(products, ["brand"], ["pos"], n)


def brands_by_tier(brands):
    """Brands with their group (furniture or fit-out) and tier, one row per brand."""
    name, kind = F.lower("name"), F.lower(F.coalesce("type", F.lit("")))
    raw_tier = F.lower(F.coalesce("tier", F.lit("")))
    listed = F.when(raw_tier.isin("budgetary", "high", "premium"), tier_of("tier")).when(
        raw_tier.isin("", "mid"), F.lit("mid")
    )
    by_name = name.contains("fitout")
    groups = F.array_compact(
        F.array(
            F.when(~by_name, F.lit("furniture")),
            F.when(by_name | (kind == "fitout"), F.lit("fitout")),
        )
    )
    return (
        brands.select("brand_id", "name", listed.alias("tier"), F.explode(groups).alias("brand_group"))
        .where("tier is not null")
    )


def keep_products(products):
    """Products that survive the exclusion rules, with trimmed models."""
    return products.where(
        is_kept_product("family", "model", "description", "main_category", "sub_category", "image_url")
    ).withColumn("model", F.trim(F.coalesce("model", F.lit(""))))


def normalize_counts(products):
    """Products before and after the exclusion rules per brand, one pass."""
    kept = is_kept_product("family", "model", "description", "main_category", "sub_category", "image_url")
    return products.groupBy("brand").agg(
        F.count(F.lit(1)).alias("products_before"), F.count_if(kept).alias("products_after")
    )


def strip_counts(products, cleaned):
    """Changed and total model names per brand."""
    return products.groupBy("brand").agg(
        F.count_if(F.col("model") != cleaned).alias("changed"), F.count(F.lit(1)).alias("total")
    )


def size_label(size):
    """Bytes with a unit, two decimals without trailing zeros."""
    size = F.col(size) if isinstance(size, str) else size
    units = ["B", "KB", "MB", "GB"]
    label = F.lit("0 B")
    for i, unit in reversed(list(enumerate(units))):
        scaled = F.round(size.cast("decimal(24,6)") / F.lit(1024**i).cast("decimal(12,0)"), 2).cast("decimal(18,2)")
        text = F.regexp_replace(F.regexp_replace(scaled.cast("string"), r"0+$", ""), r"\.$", "")
        low = F.lit(1024**i) if i else F.lit(1)
        high = F.lit(1024 ** (i + 1)) if i < len(units) - 1 else F.lit(2**62)
        label = F.when((size >= low) & (size < high), F.concat(text, F.lit(" " + unit))).otherwise(label)
    return label


def asset_listing(assets, search=""):
    """Stored files whose name holds the search text, newest first."""
    wanted = F.lower("pathname").contains(search.lower())
    return (
        assets.where(wanted)
        .select(
            "pathname",
            "uploaded_at",
            "size",
            size_label("size").alias("size_text"),
            F.col("pathname").rlike(r"(?i)\.(jpg|jpeg|png|webp|svg|gif)$").alias("is_image"),
        )
        .orderBy(F.desc_nulls_last("uploaded_at"), "pathname")
    )


def asset_totals(assets):
    """File count and storage used."""
    return assets.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    ).withColumn("storage", size_label("bytes"))


def result_name(brand_info_name="brand_info_name", brand_name="brand_name"):
    return or_else(brand_info_name, brand_name, F.lit("Unknown"))


def harvest_inventory(results):
    """Stored harvests: name, product count, completion time, logo (S10). To show the newest first, sort what is shown by completed_at."""
    counted = F.coalesce(
        F.when(F.col("product_count") > 0, F.col("product_count")), F.greatest(F.size("products"), F.lit(0))
    )
    return results.select(
        "filename",
        result_name().alias("name"),
        counted.cast("bigint").alias("product_count"),
        "completed_at",
        F.coalesce("logo", F.lit("")).alias("logo"),
    )


def latest_results(results):
    """Newest stored harvest of every brand."""
    rest = [c for c in results.columns if c != "name"]
    return (
        results.groupBy(name_key("name").alias("name_key"))
        .agg(F.max_by(F.struct("name", *rest), F.struct("completed_at", "filename")).alias("r"))
        .select("name_key", "r.*")
    )
