"""Brand documents: read, flatten, merge, write, restore, report."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.functions.numbers import or_else, parse_number
from billwright.functions.text import slug
from billwright.operators.ordering import first_row

PRODUCT = (
    "struct<mainCategory:string,subCategory:string,family:string,model:string,description:string,"
    "imageUrl:string,productUrl:string,websiteUrl:string,price:string,source:string,lastUpdated:string,"
    "normalization:struct<category:string,subCategory:string,rank:int,tags:array<string>,source:string>>"
)
DOCUMENT = "id string, name string, logo string, origin string, source string, type string, url string, budgetTier string, createdAt string, products string"
PRODUCT_COLUMNS = {
    "mainCategory": "main_category", "subCategory": "sub_category", "family": "family", "model": "model",
    "description": "description", "imageUrl": "image_url", "productUrl": "product_url",
    "websiteUrl": "website_url", "source": "source",
}


def read_brand_documents(spark, paths):
    """Brand documents of several folders; malformed ones and those without id are dropped, the first
    folder wins on a repeated id (S1)."""
    parts = []
    for rank, path in enumerate(paths):
        files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
        parts.append(
            files.select(
                F.lit(rank).alias("path_rank"),
                F.col("_metadata.file_name").alias("file"),
                F.from_json("value", DOCUMENT).alias("d"),
            )
        )
    raw = reduce(lambda a, b: a.unionByName(b), parts)
    docs = raw.select("path_rank", "file", "d.*").where("id is not null and id <> ''")
    return typed_brands(first_row(docs, ["id"], ["path_rank", "file"]))


def typed_brands(docs):
    """Products that are not a list become an empty list."""
    listed = F.when(F.trim("products").startswith("["), F.from_json("products", f"array<{PRODUCT}>"))
    products = F.coalesce(listed, F.array().cast(f"array<{PRODUCT}>"))
    return docs.select(
        F.col("id").alias("brand_id"),
        "name",
        "logo",
        "origin",
        "source",
        "type",
        "url",
        F.col("budgetTier").alias("tier"),
        F.col("createdAt").try_cast("timestamp").alias("created_at"),
        *[c for c in ("path_rank", "file") if c in docs.columns],
        products.alias("products"),
    )


def flatten_products(brands):
    """One row per product with brand, tier and list position; brands without products keep one row."""
    return brands.select(
        "brand_id", F.col("name").alias("brand"), "tier", F.posexplode_outer("products").alias("pos", "p")
    ).select(
        "brand_id",
        "brand",
        "tier",
        "pos",
        *[F.col(f"p.{a}").alias(b) for a, b in PRODUCT_COLUMNS.items()],
        parse_number("p.price").alias("price"),
        F.col("p.lastUpdated").try_cast("timestamp").alias("last_updated"),
        F.col("p.normalization.category").alias("norm_category"),
        F.col("p.normalization.subCategory").alias("norm_sub_category"),
        F.col("p.normalization.rank").alias("norm_rank"),
    )


def flatten_hierarchy(brands):
    """Nested categories, sub categories and families to the same flat rows.

    ``brands``: brand_id, brand, tier, categories array<struct<name, subCategories array<struct<name,
    families array<struct<name, products array<struct<model, description, imageUrl, price>>>>>>>>.
    """
    level = brands.select("brand_id", "brand", "tier", F.posexplode("categories").alias("c_pos", "c"))
    level = level.select("*", F.posexplode("c.subCategories").alias("s_pos", "s"))
    level = level.select("*", F.posexplode("s.families").alias("f_pos", "f"))
    level = level.select("*", F.posexplode("f.products").alias("p_pos", "p"))
    return level.select(
        "brand_id",
        "brand",
        "tier",
        F.struct("c_pos", "s_pos", "f_pos", "p_pos").alias("path"),
        F.col("c.name").alias("main_category"),
        F.col("s.name").alias("sub_category"),
        F.col("f.name").alias("family"),
        *[F.col(f"p.{f.name}").alias(PRODUCT_COLUMNS.get(f.name, f.name)) for f in level.schema["p"].dataType.fields],
    )


def merge_sources(sources):
    """Brands of several stores in priority order; later stores add unseen ids only (S3).

    ``sources``: list of (frame, default origin). A missing product list becomes an empty one.
    """
    parts = []
    for rank, (frame, origin) in enumerate(sources):
        own = F.col("source") if "source" in frame.columns else F.lit(None).cast("string")
        parts.append(
            frame.withColumn("origin", or_else(own, F.lit(origin))).withColumn("_rank", F.lit(rank))
        )
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "products" in merged.columns and isinstance(merged.schema["products"].dataType, T.ArrayType):
        kind = merged.schema["products"].dataType.simpleString()
        merged = merged.withColumn("products", F.coalesce("products", F.array().cast(kind)))
    order = ["_rank", *[c for c in ("brand_order", "file") if c in merged.columns]]
    return first_row(merged.where("brand_id is not null"), ["brand_id"], order).drop("_rank")


def upsert_brands(current, updates, stamped_at):
    """Updated brands replace those with the same id, new ones are added; the time is stamped."""
    stamped = updates.withColumn("updated_at", F.lit(stamped_at).cast("timestamp"))
    kept = current.join(updates.select("brand_id").distinct(), "brand_id", "left_anti")
    return kept.unionByName(stamped, allowMissingColumns=True)


def delete_brands(current, ids):
    """Brands without the deleted ids (S9). ``ids`` is a frame with brand_id."""
    return current.join(ids.select("brand_id").distinct(), "brand_id", "left_anti")


def write_catalog(products, path, name_col="brand", tier_col="tier"):
    """Flat products under brand slug and tier; only the written partitions are replaced.

    The rebalance hint lets adaptive execution split a very large brand over several files.
    """
    keyed = products.withColumn("brand_slug", slug(name_col, "_")).withColumn(
        "tier_key", or_else(tier_col, F.lit("mid"))
    )
    (
        keyed.hint("rebalance", F.col("brand_slug"), F.col("tier_key"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("brand_slug", "tier_key")
        .parquet(path)
    )


def restore_brands(results, origin="Cloud-Restore"):
    """Stored harvests as brands: name with blanks for underscores, default tier."""
    name = F.regexp_replace(or_else("brand_info_name", F.regexp_replace("filename", r"\.json$", "")), "_", " ")
    return results.select(
        F.coalesce("brand_info_id", slug(name, "-")).alias("brand_id"),
        name.alias("name"),
        F.coalesce("logo", F.lit("")).alias("logo"),
        F.lit(origin).alias("origin"),
        or_else("tier", F.lit("mid")).alias("tier"),
        "products",
        "completed_at",
    )


def sync_status(files):
    """State of each stored file (S12): failed without a readable document or name, skipped when the
    store refused it, else synced."""
    named = F.coalesce("name", F.lit("")) != ""
    status = (
        F.when(~F.coalesce("readable", F.lit(False)) | ~named, "failed")
        .when(~F.coalesce("stored", F.lit(False)), "skipped")
        .otherwise("synced")
    )
    return files.withColumn("status", status)


def sync_report(files):
    """Files per state."""
    return sync_status(files).groupBy("status").agg(F.count(F.lit(1)).alias("files"))
