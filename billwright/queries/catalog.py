"""Catalog vocabulary, sources, listings and statistics."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions import tagging, text, urls
from billwright.operators import dedup, harvest, registers, sheets, tag
from billwright.operators.settle import step_path
from billwright.queries import views as V
from billwright.queries.registry import query
from billwright.sources import brands as brand_store
from billwright.sources import catalogs, documents

TEXTS_SQL = V.sql_text(f"texts AS (SELECT DISTINCT {V.DESCRIPTION} AS t FROM part)")


def _texts(spark, sf):
    return V.parts(spark, sf).select(V.on_parts(V.DESCRIPTION).alias("t")).distinct()


def _re2(pattern):
    return pattern.replace("(?! stool)", "")


TAGS = [f"CASE WHEN regexp_matches(t, '(?i){_re2(p)}') THEN '{m} > {s}' END" for m, s, p in rules.TAXONOMY]


@query(
    "taxonomy_tags",
    f"""WITH {TEXTS_SQL}, g AS (SELECT t, list_filter([{', '.join(TAGS)}], lambda x: x IS NOT NULL) AS tags FROM texts)
SELECT t, coalesce(tags[1], '') AS first_tag, array_to_string(tags, '|') AS all_tags FROM g""",
)
def taxonomy_tags(spark, sf):
    label = lambda c: F.concat(c["main"], F.lit(" > "), c["sub"])
    tagged = _texts(spark, sf).withColumn("tags", tagging.categories_of("t"))
    return tagged.select(
        "t",
        F.coalesce(label(F.get("tags", F.lit(0))), F.lit("")).alias("first_tag"),
        F.array_join(F.transform("tags", label), "|").alias("all_tags"),
    )


@query(
    "category_first",
    f"WITH {TEXTS_SQL} SELECT t, coalesce({', '.join(TAGS)}, '') AS tag FROM texts",
)
def category_first(spark, sf):
    c = tagging.category_of("t")
    return _texts(spark, sf).withColumn("c", c).select("t", F.coalesce(F.concat("c.main", F.lit(" > "), "c.sub"), F.lit("")).alias("tag"))


def _count_sql(words, x="t"):
    return " + ".join(f"CASE WHEN contains(lower({x}), '{w}') THEN 1 ELSE 0 END" for w in words)


KW_SCORES = ", ".join(
    f"""row(({_count_sql(words)}) * 100 - {i}, '{cat}', CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(t), {w!r})' for w in kws)} THEN '{sub}'" for sub, kws in subs.items())} ELSE 'General' END)"""
    for i, (cat, (words, subs)) in enumerate(rules.KEYWORD_CATEGORIES.items())
)


@query(
    "keyword_classify",
    f"""WITH {TEXTS_SQL}, s AS (SELECT t, list_max([{KW_SCORES}]) AS b FROM texts)
SELECT t, CASE WHEN struct_extract_at(b, 1) > 0 THEN struct_extract_at(b, 2) ELSE 'Furniture' END AS category, CASE WHEN struct_extract_at(b, 1) > 0 THEN struct_extract_at(b, 3) ELSE 'General' END AS sub_category,
  CASE length(t) % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS rank FROM s""",
)
def keyword_classify(spark, sf):
    tier = F.expr("CASE length(t) % 4 WHEN 0 THEN 'Economy' WHEN 1 THEN 'premium' WHEN 2 THEN 'odd' ELSE '' END")
    return _texts(spark, sf).withColumn("k", tagging.keyword_category("t", tier)).select("t", "k.category", "k.sub_category", "k.rank")


@query(
    "bucket_and_rank",
    f"""WITH {TEXTS_SQL} SELECT t, coalesce(CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(t), {w!r})' for w in words)} THEN '{name}'" for name, _, _, words in rules.BUCKETS)} END, '') AS bucket,
  CASE {' '.join(f"WHEN regexp_matches(t, '(?i){p}') THEN {r}" for r, p in rules.RANKS)} ELSE 0 END AS rank FROM texts""",
)
def bucket_and_rank(spark, sf):
    return _texts(spark, sf).select(
        "t", F.coalesce(tagging.bucket_of("t"), F.lit("")).alias("bucket"), F.coalesce(tagging.seniority("t"), F.lit(0)).alias("rank")
    )


FEATURE_LIST = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{tag}' END" for _, tag, p in rules.FEATURES)


@query(
    "feature_tags",
    f"WITH {TEXTS_SQL} SELECT t, array_to_string(list_filter([{FEATURE_LIST}], lambda x: x IS NOT NULL), '|') AS tags FROM texts",
)
def feature_tags(spark, sf):
    return _texts(spark, sf).select("t", F.array_join(tagging.features_of("t"), "|").alias("tags"))


@query(
    "catalog_tags",
    f"""WITH {V.CATALOG_SQL}, c AS (SELECT pos, trim(concat_ws(' ', model, description)) AS t FROM catalog)
SELECT pos, coalesce({', '.join(TAGS)}, '') AS tag, CASE {' '.join(f"WHEN regexp_matches(t, '(?i){p}') THEN {r}" for r, p in rules.RANKS)} ELSE 0 END AS rank,
  array_to_string(list_filter([{FEATURE_LIST}], lambda x: x IS NOT NULL), '|') AS features FROM c""",
)
def catalog_tags(spark, sf):
    tagged = tag.tag_products(V.catalog(spark, sf))
    return tagged.select(
        "pos", F.coalesce(F.concat("tag_main", F.lit(" > "), "tag_sub"), F.lit("")).alias("tag"), F.coalesce("tag_rank", F.lit(0)).alias("rank"),
        F.array_join("tag_features", "|").alias("features"),
    )


SIZES = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' R:' || CAST(p_size + 10 AS STRING) WHEN 1 THEN p_name ELSE " + V.DESCRIPTION + " END"


@query(
    "dimensions",
    V.sql_text(f"""WITH texts AS (SELECT DISTINCT {SIZES} AS t FROM part), a AS (SELECT t, regexp_extract(t, '(?i)([0-9]{{2,4}})\\s*[x*]\\s*([0-9]{{2,4}})', 0) AS raw,
  TRY_CAST(regexp_extract(t, '(?i)([0-9]{{2,4}})\\s*[x*]\\s*([0-9]{{2,4}})', 1) AS INTEGER) AS w, TRY_CAST(regexp_extract(t, '(?i)([0-9]{{2,4}})\\s*[x*]\\s*([0-9]{{2,4}})', 2) AS INTEGER) AS d,
  regexp_extract(t, '(?i)(?:r|dia|round|circle)[:\\s]*([0-9]{{2,4}})', 0) AS rr, TRY_CAST(regexp_extract(t, '(?i)(?:r|dia|round|circle)[:\\s]*([0-9]{{2,4}})', 1) AS INTEGER) AS r FROM texts),
b AS (SELECT t, raw, rr, CASE WHEN w < 250 AND d < 250 THEN w * 10 ELSE w END AS w, CASE WHEN w < 250 AND d < 250 THEN d * 10 ELSE d END AS d, CASE WHEN r < 250 THEN r * 10 ELSE r END AS r FROM a)
SELECT t, CASE WHEN raw <> '' THEN CASE WHEN d > w AND d > 500 THEN d ELSE w END WHEN rr <> '' THEN r ELSE -1 END AS width,
  CASE WHEN raw <> '' THEN CASE WHEN d > w AND d > 500 THEN w ELSE d END WHEN rr <> '' THEN r ELSE -1 END AS depth, CASE WHEN raw <> '' THEN raw ELSE rr END AS raw FROM b"""),
)
def dimensions(spark, sf):
    texts = V.parts(spark, sf).select(V.on_parts(SIZES).alias("t")).distinct()
    sized = texts.withColumn("s", tagging.size_of("t"))
    return sized.select("t", F.coalesce("s.width", F.lit(-1)).alias("width"), F.coalesce("s.depth", F.lit(-1)).alias("depth"), F.coalesce("s.raw", F.lit("")).alias("raw"))


KEPT_SQL = f"""NOT (regexp_matches(lower(concat_ws(' ', family, trim(model), trim(description), main_category, sub_category)), '{rules.ERROR_PAGE}')
  OR regexp_matches(lower(concat_ws(' ', family, trim(model), trim(description), main_category, sub_category)), '{rules.MATERIAL_SAMPLE}')
  OR (contains(lower(sub_category || ' ' || main_category), 'discovery') AND length(image_url) <= 10))"""
ODD = """CASE pos % 10 WHEN 1 THEN 'discovery ' || sub_category ELSE sub_category END"""


@query(
    "bulk_normalize",
    f"""WITH {V.CATALOG_SQL}, c AS (SELECT * REPLACE ({ODD} AS sub_category) FROM catalog)
SELECT brand, CAST(count(*) AS BIGINT) AS products_before, CAST(count(*) FILTER ({KEPT_SQL}) AS BIGINT) AS products_after FROM c GROUP BY brand""",
)
def bulk_normalize(spark, sf):
    return registers.normalize_counts(V.catalog(spark, sf).withColumn("sub_category", F.expr(ODD)))


@query(
    "kept_products",
    f"WITH {V.CATALOG_SQL}, c AS (SELECT * REPLACE ({ODD} AS sub_category) FROM catalog) SELECT brand, pos, trim(model) AS model FROM c WHERE {KEPT_SQL}",
)
def kept_products(spark, sf):
    return registers.keep_products(V.catalog(spark, sf).withColumn("sub_category", F.expr(ODD))).select("brand", "pos", "model")


@query(
    "model_names",
    f"""WITH {V.CATALOG_SQL} SELECT brand, CAST(count(*) FILTER (regexp_matches(model, '\\s#[0-9]+$')) AS BIGINT) AS changed, CAST(count(*) AS BIGINT) AS total FROM catalog GROUP BY brand""",
)
def model_names(spark, sf):
    return registers.strip_counts(V.catalog(spark, sf), text.strip_variant("model"))


@query(
    "text_scalars",
    V.sql_text(f"""WITH {V.CATALOG_SQL} SELECT pos, {V.key_sql('model')} AS model_key, trim(regexp_replace(model, '\\s#[0-9]+$', '')) AS plain_model,
  regexp_replace(lower(brand), '[^a-z0-9]', '-', 'g') AS brand_slug, trim(regexp_replace('  ' || brand || chr(10) || 'x ', '\\s+', ' ', 'g')) AS brand_name,
  CASE WHEN regexp_matches(product_url, '-[0-9]+$') THEN 'M #' || regexp_extract(product_url, '-([0-9]+)$', 1) ELSE 'M' END AS variant FROM catalog"""),
)
def text_scalars(spark, sf):
    return V.catalog(spark, sf).select(
        "pos", text.model_key("model").alias("model_key"), text.strip_variant("model").alias("plain_model"),
        text.slug("brand", "-").alias("brand_slug"), text.brand_name(F.concat(F.lit("  "), "brand", F.lit("\nx "))).alias("brand_name"),
        text.variant_model(F.lit("M"), "product_url").alias("variant"),
    )


IMAGES = "CASE p_partkey % 6 WHEN 0 THEN 'https://cdn.knoll.com/a.png?x=1' WHEN 1 THEN 'http://img.example.com/a.jpg' WHEN 2 THEN 'https://localhost/a.jpg' WHEN 3 THEN 'https://img.example.com/logo.svg' WHEN 4 THEN '' ELSE 'https://brand' || CAST(p_size AS STRING) || '.com/p.webp' END"
IGNORED = " OR ".join(f"contains(lower(u), '{w}')" for w in rules.NOT_PRODUCT_IMAGE)


@query(
    "url_scalars",
    V.sql_text(f"""WITH t AS (SELECT p_partkey, {IMAGES} AS u, p_brand FROM part)
SELECT p_partkey, u <> '' AND starts_with(u, 'https://') AND NOT contains(u, 'localhost') AND regexp_matches(u, '(?i)\\.(jpg|jpeg|png|webp|svg)(\\?|$)') AS good,
  starts_with(u, 'http') AND regexp_matches(split_part(u, '?', 1), '(?i)\\.(jpg|jpeg|png|webp|gif|svg)$') AND (contains(u, 'knoll.com') OR contains(lower(u), 'brand7')) AS trusted,
  length(u) >= 10 AND NOT ({IGNORED}) AS product_image,
  CASE WHEN p_partkey % 2 = 0 THEN 'www.site.com' ELSE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.com' END AS logo_domain FROM t"""),
)
def url_scalars(spark, sf):
    rows = V.table(spark, sf, "part").withColumn("u", F.expr(IMAGES))
    return rows.select(
        "p_partkey", urls.is_good_image("u").alias("good"), urls.is_trusted_image("u", F.lit("Brand7")).alias("trusted"),
        urls.is_product_image("u").alias("product_image"),
        urls.logo_domain("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit("https://www.site.com/x"))).alias("logo_domain"),
    )


SHOP = "'https://shop.example.com/product-category/' || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '/' || lower(p_type) || '-items/' END"


@query(
    "url_categories",
    V.sql_text("""WITH t AS (SELECT p_partkey, p_name, p_type FROM part), x AS (SELECT *, upper(split_part(p_name,' ',1)[1]) || substring(split_part(p_name,' ',1), 2) || ' ' || upper(split_part(p_name,' ',2)[1]) || substring(split_part(p_name,' ',2), 2) AS m FROM t)
SELECT p_partkey, m AS main, CASE WHEN p_partkey % 3 = 0 THEN m ELSE p_type[1] || lower(substring(p_type, 2)) || ' Items' END AS sub,
  CASE WHEN p_partkey % 3 = 0 THEN 'dflt' ELSE upper(p_name) END AS catalog_sub FROM x"""),
)
def url_categories(spark, sf):
    rows = V.table(spark, sf, "part").withColumn("u", F.expr(SHOP))
    return rows.withColumn("c", urls.shop_categories("u")).select(
        "p_partkey", "c.main", "c.sub", urls.catalog_categories("u", F.lit("dflt"), F.lit("f"))["sub"].alias("catalog_sub")
    )


@query(
    "category_snap",
    V.sql_text("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Office Seating' WHEN 1 THEN 'Lighting' ELSE 'Furniture' END AS main,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'Sofas' ELSE 'Stools' END WHEN 1 THEN 'General Lighting' ELSE 'Conference Tables' END AS sub,
  CASE p_size % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'budgetary' WHEN 2 THEN 'high' ELSE 'mid' END AS tier FROM part"""),
)
def category_snap(spark, sf):
    rows = V.table(spark, sf, "part").withColumn(
        "c",
        tagging.snap_category(
            F.expr("CASE p_partkey % 3 WHEN 0 THEN 'OFFICE SEATING' WHEN 1 THEN 'lighting' ELSE 'x' END"),
            F.expr("CASE WHEN p_size % 2 = 0 THEN 'sofas' ELSE 'none' END"),
        ),
    )
    tier = F.expr("CASE p_size % 5 WHEN 0 THEN 'Premium' WHEN 1 THEN 'budgetary' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'odd' ELSE NULL END")
    return rows.select("p_partkey", "c.main", "c.sub", tagging.tier_of(tier).alias("tier"))


# ------------------------------------------------------------------ statistics
@query(
    "catalog_complexity",
    f"""WITH {V.CATALOG_SQL}, s AS (SELECT brand, count(*) AS n, count(DISTINCT sub_category) AS a, count(DISTINCT CASE WHEN norm_category <> '' THEN norm_category ELSE main_category END) AS m, count(DISTINCT family) AS f FROM catalog GROUP BY brand)
SELECT brand, CAST(n AS BIGINT) AS product_count, CAST(a AS BIGINT) AS sub_categories, CAST(m AS BIGINT) AS main_categories, CAST(f AS BIGINT) AS families, round(a + f + n / 100.0, 6) AS score
FROM s ORDER BY score DESC, brand LIMIT 5""",
)
def catalog_complexity(spark, sf):
    products = V.catalog(spark, sf)
    for c in ("norm_category", "norm_sub_category"):
        products = products.withColumn(c, F.nullif(c, F.lit("")))
    return registers.catalog_complexity(products)


@query(
    "harvest_stats",
    f"""WITH {V.CATALOG_SQL} SELECT brand, 'total' AS level, '' AS name, CAST(count(*) AS BIGINT) AS products FROM catalog GROUP BY brand
UNION ALL SELECT brand, 'category', main_category, CAST(count(*) AS BIGINT) FROM catalog GROUP BY ALL UNION ALL SELECT brand, 'sub_category', sub_category, CAST(count(*) AS BIGINT) FROM catalog GROUP BY ALL""",
)
def harvest_stats(spark, sf):
    return registers.harvest_counts(V.catalog(spark, sf))


@query(
    "harvest_sample",
    f"WITH {V.CATALOG_SQL}, r AS (SELECT brand, pos, model, row_number() OVER (PARTITION BY brand ORDER BY pos) AS rn FROM catalog) SELECT brand, pos, model FROM r WHERE rn <= 10",
)
def harvest_sample(spark, sf):
    return registers.harvest_sample(V.catalog(spark, sf)).select("brand", "pos", "model")


SUPPLIER = "CASE WHEN s_suppkey % 9 = 0 THEN 'FitOut ' ELSE '' END || s_name"
SUP_TIER = "CASE s_suppkey % 5 WHEN 0 THEN 'premium' WHEN 1 THEN 'budgetary' WHEN 2 THEN '' WHEN 3 THEN 'odd' ELSE 'mid' END"
SUP_TYPE = "CASE WHEN s_suppkey % 7 = 0 THEN 'FITOUT' ELSE '' END"


@query(
    "brands_by_tier",
    V.sql_text(f"""WITH s AS (SELECT s_suppkey AS brand_id, {SUPPLIER} AS name, {SUP_TIER} AS tier, {SUP_TYPE} AS type FROM supplier),
t AS (SELECT *, CASE tier WHEN 'premium' THEN 'high' WHEN 'budgetary' THEN 'budgetary' WHEN '' THEN 'mid' WHEN 'mid' THEN 'mid' END AS tt FROM s)
SELECT brand_id, name, tt AS tier, 'furniture' AS brand_group FROM t WHERE tt IS NOT NULL AND NOT contains(lower(name), 'fitout')
UNION ALL SELECT brand_id, name, tt, 'fitout' FROM t WHERE tt IS NOT NULL AND (contains(lower(name), 'fitout') OR type = 'FITOUT')"""),
)
def brands_by_tier(spark, sf):
    rows = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("brand_id"), F.expr(SUPPLIER).alias("name"), F.expr(SUP_TIER).alias("tier"), F.expr(SUP_TYPE).alias("type"))
    return registers.brands_by_tier(rows)


ASSET = "'assets/' || source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' ELSE '.webp' END"


@query(
    "asset_inventory",
    V.sql_text(f"""WITH a AS (SELECT {ASSET} AS pathname, n_chars * n_chars AS size FROM documents), u AS (SELECT *, CASE WHEN size <= 0 THEN 0 WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS k FROM a),
d AS (SELECT *, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS q FROM u)
SELECT pathname, size, rtrim(rtrim(CAST(CAST(CAST((CAST(size AS HUGEINT) * 200 + q) // (CAST(2 AS HUGEINT) * q) AS BIGINT) AS DECIMAL(18,0)) * CAST('0.01' AS DECIMAL(3,2)) AS VARCHAR), '0'), '.') || CASE k WHEN 0 THEN ' B' WHEN 1 THEN ' KB' WHEN 2 THEN ' MB' ELSE ' GB' END AS size_text,
  doc_id_img AS is_image FROM (SELECT *, regexp_matches(pathname, '(?i)\\.(jpg|jpeg|png|webp|svg|gif)$') AS doc_id_img FROM d)"""),
)
def asset_inventory(spark, sf):
    assets = V.table(spark, sf, "documents").select(
        F.expr(ASSET).alias("pathname"), (F.col("n_chars") * F.col("n_chars")).alias("size"), F.lit(None).cast("timestamp").alias("uploaded_at")
    )
    return registers.asset_listing(assets).select("pathname", "size", "size_text", "is_image")


@query(
    "asset_totals",
    "SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents",
)
def asset_totals(spark, sf):
    assets = V.table(spark, sf, "documents").select(F.col("n_chars").alias("size"))
    return registers.asset_totals(assets).select("files", "bytes")


# ------------------------------------------------------------------ stores
STORE = "CASE c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'local' ELSE 'both' END"


@query(
    "source_merge",
    V.sql_text(f"""WITH s AS (SELECT *, {STORE} AS store FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS brand_id, CASE WHEN store = 'local' THEN upper(c_name) ELSE c_name END AS name,
  CASE WHEN store = 'local' THEN 'Local' WHEN c_custkey % 5 = 0 THEN 'kept' ELSE 'Remote' END AS origin FROM s"""),
)
def source_merge(spark, sf):
    """Every customer is a brand of the remote store, of the local one, or of both."""
    customers = V.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("brand_id"), "c_name", F.expr(STORE).alias("store"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'kept' ELSE '' END").alias("source")
    )
    remote = customers.where("store <> 'local'").select("brand_id", F.col("c_name").alias("name"), "source")
    local = customers.where("store <> 'remote'").select("brand_id", F.upper("c_name").alias("name"))
    return brand_store.merge_sources([(remote, "Remote"), (local, "Local")]).select("brand_id", "name", "origin")


CHANGE = "CASE c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'stored' END"


@query(
    "catalog_upsert",
    V.sql_text(f"""WITH c AS (SELECT *, {CHANGE} AS state FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS brand_id, CASE WHEN state = 'stored' THEN c_name ELSE upper(c_name) END AS name, state <> 'stored' AS stamped FROM c WHERE c_custkey % 10 <> 0"""),
)
def catalog_upsert(spark, sf):
    """Every customer is a stored brand, a stored one that changes, or a new one; a tenth is deleted afterwards."""
    customers = V.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("brand_id"), "c_name", F.expr(CHANGE).alias("state"))
    current = customers.where("state <> 'new'").select("brand_id", F.col("c_name").alias("name"))
    updates = customers.where("state <> 'stored'").select("brand_id", F.upper("c_name").alias("name"))
    merged = brand_store.upsert_brands(current, updates, "2024-01-01 00:00:00")
    left = brand_store.delete_brands(merged, customers.where("c_custkey % 10 = 0").select("brand_id"))
    return left.select("brand_id", "name", F.col("updated_at").isNotNull().alias("stamped"))


DOCUMENT_SQL = V.sql_text(f"""{V.CATALOG_SQL}, docs AS (SELECT *, CAST(row_number() OVER (PARTITION BY brand_id ORDER BY pos) - 1 AS INTEGER) AS place FROM catalog)""")


def brand_folder(spark, sf):
    """One JSON document per brand, written line by line: no task or row holds a whole document."""
    line = F.to_json(F.struct("model", F.col("main_category").alias("mainCategory"), "description", F.col("price").cast("string").alias("price")))
    catalog, brands = V.catalog(spark, sf), V.brands(spark, sf)
    first = catalog.groupBy("brand_id").agg(F.min("pos").alias("_first"))
    lines = catalog.join(first, "brand_id").select(
        "brand_id", F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("pos") > F.col("_first"), F.lit(",")).otherwise(F.lit("")), line).alias("text")
    )
    head = F.concat(F.lit('{"id": "'), "brand_id", F.lit('", "name": "'), "name", F.lit('", "budgetTier": "'), "tier", F.lit('", "products": ['))
    ends = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), head.alias("text")), F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("]}").alias("text")))
    every = lines.unionByName(brands.select("brand_id", F.explode(ends).alias("e")).select("brand_id", "e.*"))
    path = step_path(spark, "brand-documents")
    every.repartition("brand_id").sortWithinPartitions("brand_id", "part", "pos").select(F.col("brand_id").alias("_file"), "text").write.partitionBy("_file").text(path)
    return path


@query(
    "brand_scan",
    f"""WITH {DOCUMENT_SQL} SELECT brand_id, tier, place AS pos, model, main_category, description, CAST(price AS VARCHAR) AS price FROM docs
UNION ALL SELECT 'none', 'mid', NULL, NULL, NULL, NULL, NULL""",
)
def brand_scan(spark, sf):
    """Documents of all brands in one store; a second store has older ones of the same brands, a broken one, one without products and one without id."""
    local = step_path(spark, "local-brands")
    old = V.brands(spark, sf).select(F.col("brand_id").alias("_file"), F.concat(F.lit('{"id": "'), "brand_id", F.lit('", "products": [{"model": "old"}]}')).alias("text"))
    more = spark.createDataFrame([("broken", '{"id": "b", "products": [{'), ("none", '{"id": "none", "budgetTier": "mid", "products": []}'), ("anonymous", '{"products": []}')], "_file string, text string")
    old.unionByName(more).repartition("_file").write.partitionBy("_file").text(local)
    found = documents.scan_brands(spark, [brand_folder(spark, sf), local], suffix=".txt")
    return found.select("brand_id", "tier", "pos", "model", "main_category", "description", "price")


@query("brand_scan_tier", f"WITH {DOCUMENT_SQL} SELECT brand_id, place AS pos, model FROM docs WHERE tier = 'high'")
def brand_scan_tier(spark, sf):
    """The tier is read from a document's header; documents of other tiers are not decoded."""
    found = documents.scan_brands(spark, [brand_folder(spark, sf)], suffix=".txt")
    return found.where("tier = 'high'").select("brand_id", "pos", "model")


@query(
    "catalog_write",
    V.sql_text(f"""WITH {V.CATALOG_SQL} SELECT regexp_replace(lower(brand), '[^a-z0-9]', '_', 'g') AS brand_slug, tier AS tier_key, pos,
  CASE WHEN tier = 'high' THEN upper(model) ELSE model END AS model FROM catalog"""),
)
def catalog_write(spark, sf):
    """The whole catalog, then the high tier once more; only its partitions are replaced."""
    path = step_path(spark, "catalog")
    products = V.catalog(spark, sf).select("brand", "tier", "pos", "model")
    brand_store.write_catalog(products, path)
    brand_store.write_catalog(products.where("tier = 'high'").withColumn("model", F.upper("model")), path)
    return spark.read.parquet(path).select(F.col("brand_slug").cast("string").alias("brand_slug"), "tier_key", "pos", "model")


@query(
    "cell_scan",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN l_returnflag || ' & ' || l_linestatus WHEN 1 THEN 'link ' || l_returnflag WHEN 2 THEN CAST(l_linenumber * 2 AS VARCHAR)
  WHEN 3 THEN CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber - 1 AS VARCHAR) END ELSE l_linestatus END AS text FROM lineitem""",
)
def cell_scan(spark, sf):
    """Cells of all kinds: rich text, links, formulas, numbers (zero reads as blank) and plain text."""
    kind = F.col("l_partkey") % 5
    cells = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(kind == 0, F.array("l_returnflag", F.lit(" & "), "l_linestatus")).otherwise(F.array().cast("array<string>")).alias("rich"),
        F.when(kind == 1, F.concat(F.lit("link "), "l_returnflag")).otherwise(F.lit("")).alias("link"),
        F.when(kind == 2, (F.col("l_linenumber") * 2).cast("string")).alias("formula"),
        F.when(kind == 3, (F.col("l_linenumber") - 1).cast("string")).otherwise(F.concat(F.lit("  "), "l_linestatus", F.lit(" "))).alias("value"),
        (kind == 3).alias("numeric"),
    )
    return cells.select("l_orderkey", "l_linenumber", "l_partkey", sheets.cell_text("value", "rich", "link", "formula", "numeric").alias("text"))


@query(
    "flatten_products",
    f"WITH {V.CATALOG_SQL} SELECT brand_id, tier, CAST(row_number() OVER (PARTITION BY brand_id ORDER BY pos) - 1 AS INTEGER) AS pos, model, CAST(price AS DOUBLE) AS price FROM catalog",
)
def flatten_products(spark, sf):
    found = documents.scan_brands(spark, [brand_folder(spark, sf)], suffix=".txt")
    return found.select("brand_id", "tier", "pos", "model", F.col("price").cast("double").alias("price"))


@query(
    "rate_card_import",
    V.sql_text(f"""SELECT p_partkey, p_type AS main_category, 'FO' AS family, 'FO-' || CAST(p_partkey AS STRING) AS model, {V.FURNISH} AS description, {V.UNIT} AS unit, CAST(CAST(p_retailprice AS DECIMAL(18,4)) AS DOUBLE) AS price FROM part"""),
)
def rate_card_import(spark, sf):
    raw = V.parts(spark, sf).select(
        "p_partkey", F.col("p_type").alias("Category"), F.col("p_brand").alias("Sub-Category"), F.concat(F.lit("FO-"), F.col("p_partkey").cast("string")).alias("Model_Code"),
        F.col("fname").alias("Item_Description"), F.expr(V.UNIT).alias("UOM"), F.col("p_retailprice").cast("string").alias("Unit_Rate_OMR"), F.lit("").alias("Image_URL"),
    )
    card = catalogs.rate_card_products(raw)
    return card.select(F.regexp_extract("model", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "main_category", "family", "model", "description", "unit", "price")


@query(
    "catalog_export",
    f'WITH {V.CATALOG_SQL} SELECT main_category AS "Main Category", sub_category AS "Sub Category", family AS "Family", model AS "Model", description AS "Description", image_url AS "Image URL", CAST(price AS DOUBLE) AS "Price", product_url AS "Product URL" FROM catalog',
)
def catalog_export(spark, sf):
    return catalogs.export_columns(V.catalog(spark, sf))


def _results(spark, sf):
    """Stored harvests: one per order, named after a customer."""
    return V.table(spark, sf, "orders").select(
        F.expr("'h-' || CAST(o_orderkey AS STRING) || '.json'").alias("filename"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Cust_' || CAST(o_custkey AS STRING) END").alias("brand_info_name"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'cust ' || CAST(o_custkey AS STRING) ELSE '' END").alias("brand_name"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 50 END").alias("product_count"),
        F.expr("transform(sequence(1, 1 + CAST(o_orderkey % 3 AS INT)), x -> 'p')").alias("products"),
        F.col("o_orderdate").cast("timestamp").alias("completed_at"),
        F.lit(None).cast("string").alias("logo"), F.lit("").alias("tier"), F.lit(None).cast("string").alias("brand_info_id"),
        F.expr("o_orderkey % 6 <> 0").alias("readable"), F.expr("o_orderkey % 5 <> 0").alias("stored"),
    )


RESULT_NAME = "CASE WHEN o_orderkey % 3 <> 0 THEN 'Cust_' || CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN 'cust ' || CAST(o_custkey AS VARCHAR) ELSE 'Unknown' END"


@query(
    "harvest_inventory",
    f"""SELECT 'h-' || CAST(o_orderkey AS VARCHAR) || '.json' AS filename, {RESULT_NAME} AS name,
  CAST(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 50 > 0 THEN o_orderkey % 50 ELSE 1 + o_orderkey % 3 END AS BIGINT) AS product_count FROM orders""",
)
def harvest_inventory(spark, sf):
    return registers.harvest_inventory(_results(spark, sf)).select("filename", "name", "product_count")


@query(
    "latest_results",
    f"""WITH r AS (SELECT 'h-' || CAST(o_orderkey AS VARCHAR) || '.json' AS filename, {RESULT_NAME} AS name, o_orderdate AS completed_at FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY completed_at DESC, filename DESC) AS rn FROM r) SELECT lower(trim(name)) AS name_key, filename FROM k WHERE rn = 1""",
)
def latest_results(spark, sf):
    return registers.latest_results(registers.harvest_inventory(_results(spark, sf))).select("name_key", "filename")


@query(
    "restored_brands",
    """SELECT 'h-' || CAST(o_orderkey AS VARCHAR) AS file, CASE WHEN o_orderkey % 3 <> 0 THEN 'Cust ' || CAST(o_custkey AS VARCHAR) ELSE 'h-' || CAST(o_orderkey AS VARCHAR) END AS name,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'cust-' || CAST(o_custkey AS VARCHAR) ELSE 'h-' || CAST(o_orderkey AS VARCHAR) END AS brand_id, 'mid' AS tier FROM orders""",
)
def restored_brands(spark, sf):
    out = brand_store.restore_brands(_results(spark, sf).withColumn("products", F.col("filename")))
    return out.select(F.regexp_replace("products", r"\.json$", "").alias("file"), "name", "brand_id", "tier")


@query(
    "sync_report",
    f"""WITH r AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'synced' END AS status FROM orders) SELECT status, CAST(count(*) AS BIGINT) AS files FROM r GROUP BY status""",
)
def sync_report(spark, sf):
    return brand_store.sync_report(_results(spark, sf).withColumn("name", registers.result_name()))


# ------------------------------------------------------------------ deduplication
def _harvested(spark, sf):
    """Products of several harvests with repeats: model, image, address and categories from parts."""
    return V.parts(spark, sf).select(
        (F.col("p_partkey") % 7).alias("harvest_id"), (F.col("p_partkey") % 3).alias("page_id"), F.col("p_partkey").alias("pos"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(fname) ELSE fname END").alias("model"),
        F.expr("CASE WHEN p_size % 9 = 0 THEN 'https://x.com/logo.png' ELSE 'https://x.com/img-' || CAST(p_size % 4 AS STRING) || '.png' END").alias("image_url"),
        F.expr("'https://x.com/P/' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'a' END").alias("product_url"),
        F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Products' WHEN 1 THEN 'General' WHEN 2 THEN 'Homepage' WHEN 3 THEN 'Chairs' ELSE 'Desks' END").alias("main_category"),
        F.expr("CASE WHEN p_size % 8 = 0 THEN 'Executive' ELSE CASE p_partkey % 5 WHEN 0 THEN 'Products' WHEN 1 THEN 'General' WHEN 2 THEN 'Homepage' WHEN 3 THEN 'Chairs' ELSE CASE WHEN p_size % 3 = 0 THEN 'x' ELSE 'Desks' END END END").alias("sub_category"),
    )


HARVESTED_SQL = V.sql_text(f"""harvested AS (SELECT p_partkey % 7 AS harvest_id, p_partkey % 3 AS page_id, p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN upper({V.FURNISH}) ELSE {V.FURNISH} END AS model,
  CASE WHEN p_size % 9 = 0 THEN 'https://x.com/logo.png' ELSE 'https://x.com/img-' || CAST(p_size % 4 AS STRING) || '.png' END AS image_url,
  'https://x.com/P/' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'a' END AS product_url,
  CASE p_partkey % 5 WHEN 0 THEN 'Products' WHEN 1 THEN 'General' WHEN 2 THEN 'Homepage' WHEN 3 THEN 'Chairs' ELSE 'Desks' END AS main_category,
  CASE WHEN p_size % 8 = 0 THEN 'Executive' ELSE CASE p_partkey % 5 WHEN 0 THEN 'Products' WHEN 1 THEN 'General' WHEN 2 THEN 'Homepage' WHEN 3 THEN 'Chairs' ELSE CASE WHEN p_size % 3 = 0 THEN 'x' ELSE 'Desks' END END END AS sub_category
  FROM part)""")
DEDUP_KEYS = {
    "model_image": ("harvest_id, lower(model || '|' || image_url)", "NOT contains(image_url, 'logo')"),
    "model_url": ("harvest_id, lower(model || '|' || product_url)", "true"),
    "model_image_exact": ("harvest_id, model || '|' || image_url", "true"),
    "title": ("harvest_id, page_id, lower(model)", "true"),
}


@query(
    "dedup_first",
    f"WITH {HARVESTED_SQL} "
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, harvest_id, min(pos) AS pos FROM harvested WHERE {w} GROUP BY {k}" for r, (k, w) in DEDUP_KEYS.items()),
)
def dedup_first(spark, sf):
    rows = _harvested(spark, sf)
    parts = [dedup.unique_products(rows, r).select(F.lit(r).alias("rule"), "harvest_id", "pos") for r in DEDUP_KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "dedup_priority",
    f"""WITH RECURSIVE {HARVESTED_SQL}, k AS (SELECT *, lower(product_url) AS u, main_category <> sub_category AS s, lower(main_category) IN ('homepage','products','general','select category') AS g,
   row_number() OVER (PARTITION BY harvest_id, lower(product_url) ORDER BY pos) AS i FROM harvested WHERE NOT contains(image_url, 'logo')),
walk AS (SELECT harvest_id, u, i, pos, s, g FROM k WHERE i = 1
  UNION ALL SELECT k.harvest_id, k.u, k.i, CASE WHEN (k.s AND NOT w.s) OR (NOT k.g AND w.g) THEN k.pos ELSE w.pos END, CASE WHEN (k.s AND NOT w.s) OR (NOT k.g AND w.g) THEN k.s ELSE w.s END,
    CASE WHEN (k.s AND NOT w.s) OR (NOT k.g AND w.g) THEN k.g ELSE w.g END FROM walk w JOIN k ON k.harvest_id = w.harvest_id AND k.u = w.u AND k.i = w.i + 1)
SELECT harvest_id, u AS url_key, arg_max(pos, i) AS pos FROM walk GROUP BY ALL""",
)
def dedup_priority(spark, sf):
    return dedup.prefer_specific(_harvested(spark, sf)).select("harvest_id", F.lower("product_url").alias("url_key"), "pos")


@query(
    "brand_finalize",
    f"""WITH {V.CATALOG_SQL} SELECT regexp_replace(lower(brand), '[^a-z0-9]', '-', 'g') AS brand_id, brand AS name, max(tier) AS tier, CAST(count(*) AS BIGINT) AS product_count FROM catalog GROUP BY brand""",
)
def brand_finalize(spark, sf):
    products = V.catalog(spark, sf)
    brands = V.brands(spark, sf).select(F.col("name").alias("brand"), "logo", "tier")
    return harvest.brand_records(products, brands, "2024-01-01 00:00:00").select("brand_id", "name", "tier", "product_count")
