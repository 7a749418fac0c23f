"""Rate cards and catalog exchange files."""

from pyspark.sql import functions as F

from billwright.functions.numbers import parse_number

RATE_CARD = (
    "Category string, `Sub-Category` string, Model_Code string, Item_Description string, UOM string, "
    "Unit_Rate_OMR string, Image_URL string"
)
EXPORT_COLUMNS = {
    "main_category": "Main Category", "sub_category": "Sub Category", "family": "Family", "model": "Model",
    "description": "Description", "image_url": "Image URL", "price": "Price", "product_url": "Product URL",
}


def read_rate_card(spark, path, tier="mid"):
    """Rate-card CSV as products; the family is the code before its number."""
    raw = spark.read.csv(path, schema=RATE_CARD, header=True, quote='"', escape='"', multiLine=True)
    return rate_card_products(raw, tier)


def rate_card_products(raw, tier="mid"):
    return raw.select(
        F.lit(tier).alias("tier"),
        F.col("Category").alias("main_category"),
        F.col("Sub-Category").alias("sub_category"),
        F.regexp_extract("Model_Code", r"^(.*?)-?\d*$", 1).alias("family"),
        F.col("Model_Code").alias("model"),
        F.col("Item_Description").alias("description"),
        F.col("UOM").alias("unit"),
        F.coalesce(parse_number("Unit_Rate_OMR"), F.lit(0)).alias("price"),
        F.coalesce("Image_URL", F.lit("")).alias("image_url"),
    )


def export_columns(products):
    """Eight named columns in fixed order."""
    return products.select(*[F.col(c).alias(title) for c, title in EXPORT_COLUMNS.items()])


def write_export(products, path, file_format="csv"):
    """Catalog export as CSV or Parquet; Spark writes one file per task."""
    writer = export_columns(products).write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.parquet(path)
