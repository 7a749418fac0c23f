"""Catalog, matching and price queries."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.operators import attributes, choices, hardening, matching, rate_cards, value_engineering
from billwright.operators.settle import settle
from billwright.plans import auto_match as flow
from billwright.queries import views as V
from billwright.queries.registry import query

SYN = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in rules.SYNONYMS.items()) + "}"


def fuzzy_sql(targets, products):
    """Every target against every product of its brand, stage by stage: the slow, literal way."""
    return f"""t AS (SELECT DISTINCT brand_id, {V.key_sql('model')} AS tk, CASE WHEN length(category) > 2 THEN lower(trim(category)) ELSE '' END AS cat FROM {targets}),
p AS (SELECT brand_id, {V.key_sql('model')} AS pk, lower(main_category) AS mc, lower(sub_category) AS sc, min(pos) AS pos FROM {products} GROUP BY ALL),
pairs AS (SELECT t.*, p.pk, p.mc, p.sc, p.pos, string_split(tk, ' ') AS ta, string_split(pk, ' ') AS pa,
   (contains(mc, cat) OR contains(sc, cat) OR contains(cat, mc) OR contains(cat, sc)) AS fits,
   list_distinct(list_filter(string_split(tk, ' '), lambda w: length(w) > 2 OR regexp_full_match(w, '[0-9]+'))) AS tw,
   list_filter(string_split(pk, ' '), lambda w: length(w) > 2 OR regexp_full_match(w, '[0-9]+')) AS pw
  FROM t JOIN p USING (brand_id) WHERE tk <> ''),
staged AS (SELECT *, CASE WHEN pk = tk THEN 1 WHEN contains(pk, tk) OR contains(tk, pk) THEN 2
   WHEN len(list_filter(ta, lambda w: list_contains(pa, w) OR list_has_any(coalesce({SYN}[w], []), pa))) > 0 THEN 3 ELSE 9 END AS stage FROM pairs),
firsts AS (SELECT *, min(stage) OVER (PARTITION BY brand_id, tk, cat) AS ms FROM staged),
cand AS (SELECT *, max(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY brand_id, tk, cat) AS any_fit FROM firsts WHERE stage = ms AND stage < 9),
scored AS (SELECT *, CASE WHEN stage = 1 THEN 1.0 WHEN len(tw) = 0 THEN 0.0 ELSE
    CAST(len(list_filter(pw, lambda w: list_contains(tw, w))) AS DOUBLE) / greatest(len(tw), len(pw)) +
    CASE WHEN len(list_filter(pw, lambda w: list_contains(tw, w))) < len(tw) THEN
      0.25 * len(list_filter(ta, lambda w: list_contains(tw, w) AND NOT list_contains(pw, w) AND list_has_any(coalesce({SYN}[w], []), pa))) ELSE 0 END END AS score
  FROM cand WHERE stage = 1 OR any_fit = 0 OR fits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY brand_id, tk, cat ORDER BY CASE WHEN stage = 1 THEN 0 ELSE -score END, pos) AS rn FROM scored),
won AS (SELECT brand_id, tk, cat, pos, stage, score FROM ranked WHERE rn = 1 AND (stage = 1 OR len(tw) = 0 OR score >= 0.5))"""


TARGET_KEYS = f"{V.key_sql('i.model')} = w.tk AND CASE WHEN length(i.category) > 2 THEN lower(trim(i.category)) ELSE '' END = w.cat"


@query(
    "fuzzy_model_match",
    f"""WITH {V.CATALOG_SQL}, {V.IDENTIFIED_SQL}, {fuzzy_sql('identified', 'catalog')}
SELECT i.target_id, i.brand_id, i.model, coalesce(w.pos, -1) AS match_pos, CAST(coalesce(w.stage, -1) AS INTEGER) AS match_stage, coalesce(round(w.score, 6), -1.0) AS match_score,
  c.model AS match_model
FROM identified i LEFT JOIN won w ON w.brand_id = i.brand_id AND {TARGET_KEYS} LEFT JOIN catalog c ON c.brand_id = w.brand_id AND c.pos = w.pos""",
)
def fuzzy_model_match(spark, sf):
    products = V.catalog(spark, sf)
    matched = matching.with_product(matching.match_models(V.identified(spark, sf), products), products, ["model"])
    return matched.select(
        "target_id", "brand_id", "model",
        F.coalesce("match_pos", F.lit(-1)).alias("match_pos"),
        F.coalesce("match_stage", F.lit(-1)).alias("match_stage"),
        F.coalesce("match_score", F.lit(-1.0)).alias("match_score"),
        "match_model",
    )


def _candidates(spark, sf):
    """Candidate brands of each line: its own brand and two others, one unknown."""
    extra = [("p_brand", "p_brand"), ("p_partkey", "p_partkey"), ("l_linestatus", "l_linestatus")]
    lines = V.by_document_size(spark, sf, lambda lines, whole: V.numbered_boq(spark, sf, *extra, lines=lines, whole=whole))
    tier = F.when(F.col("l_linestatus") == "F", "mid").otherwise("high")
    other = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))
    options = F.array(
        F.struct(F.lit(1).alias("candidate_order"), other.alias("candidate_brand")),
        F.struct(F.lit(2).alias("candidate_order"), F.concat(F.lit(" "), F.upper("p_brand")).alias("candidate_brand")),
        F.struct(F.lit(3).alias("candidate_order"), F.lit("Newcomer").alias("candidate_brand")),
    )
    return lines.select("doc_id", "sn", tier.alias("tier"), "description", "qty", "rate", F.explode(options).alias("c")).select(
        "doc_id", "sn", "tier", "description", "qty", "rate", "c.*"
    )


CANDIDATES_SQL = """candidates AS (SELECT b.doc_id, b.sn, CASE WHEN l_linestatus = 'F' THEN 'mid' ELSE 'high' END AS tier, description, qty, rate, x.o AS candidate_order,
  CASE x.o WHEN 1 THEN 'Brand#' || CAST(p_partkey % 25 + 1 AS VARCHAR) WHEN 2 THEN ' ' || upper(p_brand) ELSE 'Newcomer' END AS candidate_brand
  FROM boq b CROSS JOIN (VALUES (1), (2), (3)) x(o)),
allowed AS (SELECT c.* FROM candidates c LEFT JOIN brands b ON lower(trim(b.name)) = lower(trim(c.candidate_brand)) WHERE b.tier IS NULL OR b.tier = c.tier)"""


@query(
    "tier_isolation",
    f"""WITH {V.BOQ_SQL}, {V.BRANDS_SQL}, {CANDIDATES_SQL}
SELECT doc_id, sn, candidate_order, candidate_brand, a.tier, coalesce(b.brand_id, '') AS brand_id FROM allowed a LEFT JOIN brands b ON lower(trim(b.name)) = lower(trim(a.candidate_brand))""",
)
def tier_isolation(spark, sf):
    brands = V.brands(spark, sf)
    kept = matching.isolate_tiers(_candidates(spark, sf), brands)
    found = matching.resolve_brands(kept, brands, "candidate_brand", "tier")
    return found.select("doc_id", "sn", "candidate_order", "candidate_brand", "tier", F.coalesce("brand_id", F.lit("")).alias("brand_id"))


@query(
    "brand_resolution",
    V.sql_text(f"""WITH b AS (SELECT DISTINCT p_brand || '-' || CAST(p_size % 4 AS VARCHAR) AS brand_id, p_brand AS name, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' WHEN 2 THEN 'Budgetary' ELSE '' END AS tier, p_size % 4 AS brand_order
   FROM part WHERE NOT ({V.BRAND_NO} % 5 = p_size % 4)), w AS (SELECT DISTINCT p_brand, x.tier FROM part, (VALUES ('high'), ('mid'), ('budgetary')) x(tier))
SELECT p_brand AS brand, w.tier, (SELECT arg_min(brand_id, CASE WHEN coalesce(nullif(lower(b.tier), ''), 'mid') = w.tier THEN 0 ELSE 10 END + brand_order) FROM b WHERE b.name = w.p_brand) AS brand_id FROM w"""),
)
def brand_resolution(spark, sf):
    parts = V.table(spark, sf, "part")
    brands = parts.where(f"not ({V.BRAND_NO} % 5 = p_size % 4)").select(
        F.expr("p_brand || '-' || CAST(p_size % 4 AS STRING)").alias("brand_id"), F.col("p_brand").alias("name"),
        F.expr("CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' WHEN 2 THEN 'Budgetary' ELSE '' END").alias("tier"),
        (F.col("p_size") % 4).alias("brand_order"), F.lit("").alias("logo"),
    ).distinct()
    wanted = parts.select(F.col("p_brand").alias("brand"), F.explode(F.array(*[F.lit(t) for t in rules.TIERS])).alias("tier")).distinct()
    return matching.resolve_brands(wanted, brands).select("brand", "tier", "brand_id")


@query(
    "candidate_context",
    f"""WITH {V.CATALOG_SQL} SELECT brand_id, 'model' AS kind, CAST(pos AS BIGINT) AS pos, model AS text FROM catalog
UNION ALL SELECT DISTINCT brand_id, 'sub_category', NULL, sub_category FROM catalog WHERE trim(sub_category) <> ''""",
)
def candidate_context(spark, sf):
    return matching.candidate_context(V.catalog(spark, sf))


@query(
    "candidate_context_500",
    f"""WITH {V.CATALOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY pos) AS rn FROM catalog)
SELECT brand_id, 'model' AS kind, CAST(pos AS BIGINT) AS pos, model AS text FROM r WHERE rn <= 500
UNION ALL SELECT DISTINCT brand_id, 'sub_category', NULL, sub_category FROM catalog WHERE trim(sub_category) <> ''""",
)
def candidate_context_500(spark, sf):
    """The first 500 models of each brand, as many as a prompt takes."""
    return matching.candidate_context(V.catalog(spark, sf), rules.CONTEXT_MODELS)


def _flow(spark, sf):
    """Identification names the description itself for most brands; discoveries exist for a few."""
    candidates = _candidates(spark, sf)
    brands, products = V.brands(spark, sf), V.catalog(spark, sf)
    names = settle(candidates.select("candidate_brand", "description").distinct(), "names")
    length = F.length("description")
    ident = names.select(
        "candidate_brand", "description",
        F.when(length % 7 == 0, "error").otherwise("success").alias("status"),
        F.lit("").alias("brand"),
        F.when(length % 5 == 0, F.lit("FAILED")).when(length % 3 == 0, F.concat("description", F.lit(" xl"))).otherwise(F.col("description")).alias("model"),
        F.lit("").alias("main_category"),
    )
    found = names.where("candidate_brand = 'Newcomer' and length(description) % 2 = 0").select(
        F.col("candidate_brand").alias("brand"), F.col("description").alias("model"), F.lit("").alias("main_category"),
        F.lit("http://x").alias("image_url"), F.lit("100.5").alias("price"), F.col("description").alias("description"),
    )
    return flow.auto_match(candidates, ident, brands, products, found), products


FLOW_SQL = f"""{V.BOQ_SQL}, {V.BRANDS_SQL}, {V.CATALOG_SQL}, {CANDIDATES_SQL},
asked AS (SELECT doc_id, sn, a.tier, candidate_order, candidate_brand, description,
    CASE WHEN length(description) % 3 = 0 THEN description || ' xl' ELSE description END AS model, b.brand_id
  FROM allowed a LEFT JOIN brands b ON lower(trim(b.name)) = lower(trim(candidate_brand)) WHERE length(description) % 7 <> 0 AND length(description) % 5 <> 0),
targets AS (SELECT DISTINCT brand_id, model, '' AS category FROM asked WHERE brand_id IS NOT NULL),
{fuzzy_sql('targets', 'catalog')},
hits AS (SELECT k.doc_id, k.sn, k.tier, k.candidate_order, k.candidate_brand AS brand, w.pos, k.brand_id, k.model,
    CASE WHEN w.pos IS NOT NULL THEN 'local-database' ELSE 'ai-discovery-hardened' END AS source, c.model AS found_model, k.description
  FROM asked k LEFT JOIN won w ON w.brand_id = k.brand_id AND w.tk = {V.key_sql('k.model')} LEFT JOIN catalog c ON c.brand_id = w.brand_id AND c.pos = w.pos
  WHERE w.pos IS NOT NULL OR (k.candidate_brand = 'Newcomer' AND length(k.description) % 2 = 0 AND k.model = k.description)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sn, tier ORDER BY candidate_order) AS rn FROM hits),
results AS (SELECT DISTINCT c.doc_id, c.sn, c.tier, c.qty, c.rate, c.description, b.brand, b.source, b.brand_id, CASE WHEN b.source = 'local-database' THEN b.found_model ELSE b.description END AS model,
    CASE WHEN b.source IS NULL THEN 'no_match' ELSE 'success' END AS status
  FROM candidates c LEFT JOIN best b ON b.doc_id = c.doc_id AND b.sn = c.sn AND b.tier = c.tier AND b.rn = 1)"""


@query(
    "first_success",
    f"""WITH {FLOW_SQL} SELECT doc_id, sn, tier, status, coalesce(source, '') AS source, coalesce(brand, '') AS brand, coalesce(CASE WHEN status = 'success' THEN model END, '') AS model FROM results""",
)
def first_success(spark, sf):
    results, _ = _flow(spark, sf)
    return results.select("doc_id", "sn", "tier", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "brand", "model")])


@query(
    "outcome_rollup",
    f"""WITH {FLOW_SQL} SELECT tier, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS success, CAST(0 AS BIGINT) AS error,
  CAST(count(*) FILTER (source = 'ai-discovery-hardened') AS BIGINT) AS newly_added FROM results GROUP BY tier""",
)
def outcome_rollup(spark, sf):
    return flow.outcome(_flow(spark, sf)[0])


def snap_sql(targets, products):
    """Most expensive product of the brand with containment either way."""
    return f"""sk AS (SELECT DISTINCT brand_id, {V.key_sql('model')} AS tk FROM {targets} WHERE brand_id IS NOT NULL),
sp AS (SELECT brand_id, {V.key_sql('model')} AS pk, pos, coalesce(price, 0) AS price FROM {products}),
snap AS (SELECT k.brand_id, k.tk, arg_min(p.pos, (-p.price, p.pos)) AS pos FROM sk k JOIN sp p ON p.brand_id = k.brand_id AND (contains(pk, tk) OR contains(tk, pk)) GROUP BY ALL)"""


@query(
    "catalog_snap",
    f"""WITH {V.CATALOG_SQL}, {V.IDENTIFIED_SQL}, {snap_sql('identified', 'catalog')}
SELECT i.target_id, coalesce(s.pos, -1) AS snap_pos FROM identified i LEFT JOIN snap s ON s.brand_id = i.brand_id AND s.tk = {V.key_sql('i.model')}""",
)
def catalog_snap(spark, sf):
    snapped = matching.snap_to_catalog(V.identified(spark, sf), V.catalog(spark, sf))
    return snapped.select("target_id", F.coalesce("snap_pos", F.lit(-1)).alias("snap_pos"))


@query(
    "auto_match_snap",
    f"""WITH {FLOW_SQL}, won2 AS (SELECT * FROM results WHERE status = 'success'), {snap_sql('won2', 'catalog')}
SELECT r.doc_id, r.sn, r.tier, CASE WHEN c.pos IS NULL THEN r.model ELSE coalesce(nullif(c.model, ''), '') END AS selected_model,
  coalesce(nullif(c.main_category, ''), CASE WHEN r.source = 'local-database' THEN NULL ELSE 'Furniture' END, 'Office Seating') AS selected_main_cat,
  CAST(round(CASE WHEN c.price > 0 THEN c.price ELSE 100.5 END, 2) AS DOUBLE) AS rate,
  CAST(round(CAST(round(CASE WHEN c.price > 0 THEN c.price ELSE CAST('100.5' AS DECIMAL(18,4)) END, 2) AS DECIMAL(18,2)) * r.qty, 2) AS DOUBLE) AS amount
FROM won2 r LEFT JOIN snap s ON s.brand_id = r.brand_id AND s.tk = {V.key_sql('r.model')} LEFT JOIN catalog c ON c.brand_id = s.brand_id AND c.pos = s.pos""",
)
def auto_match_snap(spark, sf):
    results, products = _flow(spark, sf)
    return flow.snap_results(results, products).select("doc_id", "sn", "tier", "selected_model", "selected_main_cat", "rate", "amount")


FURNISHED = ("roomed", f"CASE WHEN l_suppkey % 2 = 0 THEN '[Room ' || CAST(l_suppkey % 12 AS STRING) || '] ' ELSE '' END || {V.FURNISH}")


@query(
    "dedupe_match_broadcast",
    V.sql_text(f"""WITH {V.BOQ_SQL}, {V.CATALOG_SQL}, wanted AS (SELECT DISTINCT p_brand AS brand_id, description AS model, '' AS category FROM boq), {fuzzy_sql('wanted', 'catalog')}
SELECT doc_id, sn, {FURNISHED[1]} AS description, b.description AS clean_description, coalesce(w.pos, -1) AS match_pos, CAST(coalesce(w.stage, -1) AS INTEGER) AS match_stage
FROM boq b LEFT JOIN won w ON w.brand_id = b.p_brand AND w.tk = {V.key_sql('b.description')} AND w.cat = ''"""),
)
def dedupe_match_broadcast(spark, sf):
    """Each distinct description of a brand is matched once, by the model matcher."""
    rows = V.numbered_boq(spark, sf, FURNISHED, ("brand_id", "p_brand")).withColumn("description", F.col("roomed"))
    products = V.catalog(spark, sf)

    def matcher(keys):
        asked = keys.withColumn("model", F.col("clean_description")).withColumn("category", F.lit(""))
        return matching.match_models(asked, products).select("brand_id", "clean_description", "match_pos", "match_stage")

    matched = matching.match_once(rows, matcher, keys=("brand_id",))
    return matched.select(
        "doc_id", "sn", "description", "clean_description",
        F.coalesce("match_pos", F.lit(-1)).alias("match_pos"), F.coalesce("match_stage", F.lit(-1)).alias("match_stage"),
    )


@query(
    "price_backfill",
    V.sql_text(f"""WITH {V.BOQ_SQL}, {V.CATALOG_SQL}, r AS (SELECT b.doc_id, b.sn, b.p_brand AS selected_brand, c.model AS selected_model,
    CASE WHEN b.p_partkey % 3 = 0 THEN c.product_url ELSE 'other' END AS selected_model_url, CASE b.p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE CAST(b.rate AS VARCHAR) END AS rate,
    CASE WHEN b.p_partkey % 6 = 0 THEN 'kept' ELSE '' END AS brand_desc FROM boq b JOIN catalog c ON c.pos = b.p_partkey),
u AS (SELECT brand_id, product_url, min(pos) AS pos FROM catalog WHERE product_url <> '' GROUP BY ALL), m AS (SELECT brand_id, model, min(pos) AS pos FROM catalog GROUP BY ALL),
f AS (SELECT r.*, least(u.pos, m.pos) AS pos FROM r LEFT JOIN u ON u.brand_id = r.selected_brand AND u.product_url = r.selected_model_url LEFT JOIN m ON m.brand_id = r.selected_brand AND m.model = r.selected_model)
SELECT doc_id, sn, coalesce(CAST(CASE WHEN selected_model <> '' AND c.price > 0 AND (f.rate = '' OR f.rate = '0') THEN round(c.price, 2) ELSE round({V.number_sql('f.rate')}, 2) END AS DOUBLE), -1) AS rate,
  CASE WHEN selected_model <> '' AND c.price > 0 AND (f.rate = '' OR f.rate = '0') AND f.brand_desc = '' THEN c.description ELSE f.brand_desc END AS brand_desc
FROM f LEFT JOIN catalog c ON c.brand_id = f.selected_brand AND c.pos = f.pos"""),
)
def price_backfill(spark, sf):
    products, brands = V.catalog(spark, sf), V.brands(spark, sf)
    lines = V.numbered_boq(spark, sf, ("p_partkey", "p_partkey"))
    chosen = products.select(F.col("pos").alias("p_partkey"), F.col("brand").alias("selected_brand"), F.col("model").alias("selected_model"), "product_url")
    rows = lines.join(chosen, "p_partkey").select(
        "doc_id", "sn", "selected_brand", "selected_model",
        F.when(F.col("p_partkey") % 3 == 0, F.col("product_url")).otherwise("other").alias("selected_model_url"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE CAST(rate AS STRING) END").alias("rate"),
        F.lit(None).cast("decimal(18,4)").alias("base_price"),
        F.expr("CASE WHEN p_partkey % 6 = 0 THEN 'kept' ELSE '' END").alias("brand_desc"),
    )
    filled = matching.fill_prices(rows, products, brands)
    return filled.select("doc_id", "sn", F.coalesce(F.col("rate").cast("double"), F.lit(-1.0)).alias("rate"), "brand_desc")


# ------------------------------------------------------------------ value engineering
def _bucket_sql(text):
    whens = " ".join(f"WHEN {' OR '.join(f'contains({text}, {w!r})' for w in words)} THEN '{name}'" for name, _, _, words in rules.BUCKETS)
    return f"CASE {whens} END"


ASSIGNED = {"desking": "Brand#1", "seating": "Brand#2", "softSeating": "Brand#3", "accessories": ""}


@query(
    "ve_routing",
    f"""WITH {V.BOQ_SQL}, t AS (SELECT doc_id, sn, description, {_bucket_sql('lower(description)')} AS bucket FROM boq),
r AS (SELECT *, CASE bucket WHEN 'seating' THEN 'Brand#2' WHEN 'softSeating' THEN 'Brand#3' WHEN 'accessories' THEN '' ELSE 'Brand#1' END AS target_brand,
  CASE bucket WHEN 'desking' THEN 'DESKING' WHEN 'seating' THEN 'SEATING' WHEN 'softSeating' THEN 'SOFT SEATING' WHEN 'accessories' THEN 'ACCESSORIES' ELSE '' END AS category_scope FROM t)
SELECT doc_id, sn, description, target_brand, category_scope FROM r WHERE target_brand <> ''""",
)
def ve_routing(spark, sf):
    routed = value_engineering.route(V.numbered_boq(spark, sf), ASSIGNED)
    return routed.select("doc_id", "sn", "description", "target_brand", F.coalesce("category_scope", F.lit("")).alias("category_scope"))


@query(
    "ve_match",
    V.sql_text(f"""WITH {V.CATALOG_SQL}, {V.BRANDS_SQL}, {V.IDENTIFIED_SQL}, {fuzzy_sql('identified', 'catalog')},
d AS (SELECT DISTINCT i.brand_id, {V.key_sql('i.model')} AS mk, 'Detail of ' || {V.key_sql('i.model')} AS description FROM identified i WHERE target_id % 7 IN (5, 6)),
j AS (SELECT i.*, w.pos, c.model AS cm, c.price, c.main_category, d.description AS dd, target_id % 11 <> 0 AS ok
  FROM identified i LEFT JOIN won w ON w.brand_id = i.brand_id AND {TARGET_KEYS} LEFT JOIN catalog c ON c.brand_id = w.brand_id AND c.pos = w.pos
  LEFT JOIN d ON d.brand_id = i.brand_id AND d.mk = {V.key_sql('i.model')})
SELECT target_id, CASE WHEN ok THEN 'success' ELSE 'no_match' END AS status,
  CASE WHEN NOT ok THEN '' WHEN pos IS NOT NULL THEN 'local-database' WHEN dd IS NOT NULL THEN 've-ai-discovery' ELSE 've-identity-only' END AS source,
  CASE WHEN NOT ok THEN '' WHEN pos IS NOT NULL THEN cm WHEN dd IS NOT NULL THEN {V.key_sql('model')} ELSE model END AS model,
  CAST(CASE WHEN NOT ok THEN -1 WHEN pos IS NOT NULL THEN price WHEN dd IS NOT NULL THEN 12.5 ELSE 0 END AS DOUBLE) AS price,
  CASE WHEN NOT ok THEN '' WHEN pos IS NOT NULL THEN main_category ELSE category END AS main_category FROM j"""),
)
def ve_match(spark, sf):
    products, brands = V.catalog(spark, sf), V.brands(spark, sf)
    asked = V.identified(spark, sf)
    lines = asked.select(
        "target_id", F.col("brand_id").alias("target_brand"), F.lit("").alias("category_scope"),
        F.when(F.col("target_id") % 11 == 0, "error").otherwise("success").alias("status"),
        F.lit("").alias("brand"), "model", F.col("category").alias("main_category"), F.lit("named").alias("logic"),
    )
    from billwright.functions.text import model_key

    details = asked.where("target_id % 7 in (5, 6)").select(
        F.col("brand_id").alias("brand"), model_key("model").alias("model"),
        F.concat(F.lit("Detail of "), model_key("model")).alias("description"), F.lit("").alias("image_url"),
        F.lit("12.5").alias("price"), F.lit("").alias("sub_category"),
    )
    found = value_engineering.match_lines(lines, brands, products, details)
    return found.select(
        "target_id", "status", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce(F.col("price").cast("double"), F.lit(-1.0)).alias("price"), F.coalesce("main_category", F.lit("")).alias("main_category"),
    )


# ------------------------------------------------------------------ rate card, attributes
CARD_GROUP = {"carpet tile": "Carpet Tiles", "chair": "Staff Chairs", "workstation": "Desk System", "acoustic pod": "Office Pods",
              "glass partition": "Glass Partitions", "meeting table": "Conference Tables", "pedestal": "pedestals", "sofa": "Sofas"}
GROUP_OF = "CASE " + " ".join(f"WHEN contains(description, '{k}') THEN '{v}'" for k, v in CARD_GROUP.items()) + " END"


def _card(spark, sf):
    """Priced items per tier: one per category and brand; the high tier has no card."""
    parts = V.table(spark, sf, "part").select(
        F.expr(V.FURNISH).alias("description"), "p_brand", "p_type", F.col("p_partkey").alias("pos"), F.expr(V.TIER).alias("tier"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("price"),
    ).where("tier <> 'high'")
    return parts.groupBy("tier", F.expr("concat(description, ' by ', p_brand)").alias("description"), F.expr(GROUP_OF).alias("sub_category")).agg(
        F.min("pos").alias("pos"), F.min("price").alias("price")
    ).select(
        "tier", "pos", F.lit("Fit-out").alias("main_category"), "sub_category", F.lit("FO").alias("family"),
        F.concat(F.lit("FO-"), F.col("pos").cast("string")).alias("model"), "description", "price",
    )


def _parts_sql(x):
    return "list_filter([" + ", ".join(f"'{m}'" for m in rules.FITOUT_MATERIALS) + f"], lambda m: contains(lower({x}), m))"


def _groups_sql(x):
    pattern = lambda p: p.replace("(?! stool)", "")
    rows = ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){pattern(p)}') THEN '{s}' END" for _, s, p in rules.TAXONOMY)
    return f"CASE WHEN contains(lower({x}), 'carpet') THEN ['Carpet Tiles'] ELSE list_filter(list_distinct([{rows}]), lambda g: g IS NOT NULL) END"


CARD_SQL = V.sql_text(f"""card AS (SELECT tier, description || ' by ' || p_brand AS description, {GROUP_OF} AS sub_category, min(p_partkey) AS pos, min(price) AS price
  FROM (SELECT {V.FURNISH} AS description, p_brand, p_partkey, {V.TIER} AS tier, CAST(p_retailprice AS DECIMAL(18,4)) AS price, p_type FROM part)
  WHERE tier <> 'high' GROUP BY tier, description || ' by ' || p_brand, {GROUP_OF})""")
FITLINE = ("fit_text", "CASE p_partkey % 5 WHEN 0 THEN upper(" + V.FURNISH + ") || ' by ' || p_brand WHEN 1 THEN 'Floor finish (carpet)' WHEN 2 THEN 'toughened glass ' || p_type WHEN 3 THEN 'survey works' ELSE " + V.FURNISH + " END")


def _fit_lines(spark, sf, blank="false"):
    """The fit-out lines of every tier; some may have no text."""
    text = F.when(F.expr(blank), F.lit(" ")).otherwise(V.on_parts(FITLINE[1]))
    return V.parts(spark, sf).select(text.alias("description"), F.explode(F.array(*[F.lit(t) for t in rules.TIERS])).alias("tier"))


@query(
    "rate_card_match",
    V.sql_text(f"""WITH {CARD_SQL}, lines AS (SELECT DISTINCT {FITLINE[1]} AS description, x.tier FROM part, (VALUES ('budgetary'), ('mid'), ('high')) x(tier)),
l AS (SELECT description, tier, CASE WHEN tier = 'high' OR NOT EXISTS (SELECT 1 FROM card WHERE card.tier = lines.tier) THEN 'mid' ELSE tier END AS ct, {_groups_sql('description')} AS g, {_parts_sql('description')} AS m FROM lines),
i AS (SELECT *, {_parts_sql("description || ' ' || sub_category")} AS im FROM card),
s AS (SELECT l.description, l.tier, i.pos, i.description AS item, i.price,
   {V.key_sql('l.description')} = {V.key_sql('i.description')} OR {V.key_sql('l.description')} = 'fo ' || CAST(i.pos AS VARCHAR) AS same,
   CASE WHEN list_contains(g, i.sub_category) THEN 2 ELSE 0 END + len(list_filter(m, lambda x: list_contains(im, x))) AS score, len(m) AS nm FROM l JOIN i ON i.tier = l.ct),
r AS (SELECT *, row_number() OVER (PARTITION BY description, tier ORDER BY CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN 0 ELSE -score END, pos) AS rn FROM s WHERE same OR score > 0)
SELECT l.tier, l.description, CASE WHEN r.pos IS NULL THEN 'no_match' ELSE 'success' END AS status, coalesce(r.pos, -1) AS match_pos, coalesce(r.item, '') AS match_description,
  coalesce(CAST(r.price AS DOUBLE), -1) AS match_price, coalesce(CASE WHEN same THEN 1.0 ELSE round(CAST(score AS DOUBLE) / (2.0 + greatest(nm, 1)), 6) END, -1) AS match_score,
  CASE WHEN r.pos IS NULL THEN '' ELSE 'Fit-out' END AS match_brand, CASE WHEN r.pos IS NULL THEN '' ELSE 'FO-' || CAST(r.pos AS VARCHAR) END AS identified_model
FROM l LEFT JOIN r ON r.description = l.description AND r.tier = l.tier AND rn = 1"""),
)
def rate_card_match(spark, sf):
    found = rate_cards.match_batch(_fit_lines(spark, sf).distinct(), _card(spark, sf))
    return found.select(
        "tier", "description", "status", F.coalesce("match_pos", F.lit(-1)).alias("match_pos"),
        F.coalesce("match_description", F.lit("")).alias("match_description"),
        F.coalesce(F.col("match_price").cast("double"), F.lit(-1.0)).alias("match_price"), F.coalesce("match_score", F.lit(-1.0)).alias("match_score"),
        F.coalesce("match_brand", F.lit("")).alias("match_brand"), F.coalesce("identified_model", F.lit("")).alias("identified_model"),
    )


@query(
    "fitout_outcome",
    V.sql_text(f"""WITH {CARD_SQL}, lines AS (SELECT {FITLINE[1]} AS description, x.tier, p_partkey % 13 = 0 AS blank FROM part, (VALUES ('budgetary'), ('mid'), ('high')) x(tier)),
d AS (SELECT description, tier, blank, count(*) AS n FROM lines GROUP BY ALL),
l AS (SELECT *, CASE WHEN tier = 'high' THEN 'mid' ELSE tier END AS ct, {_groups_sql('description')} AS g, {_parts_sql('description')} AS m FROM d),
i AS (SELECT *, {_parts_sql("description || ' ' || sub_category")} AS im FROM card),
ok AS (SELECT DISTINCT l.description, l.tier FROM l JOIN i ON i.tier = l.ct WHERE {V.key_sql('l.description')} = {V.key_sql('i.description')} OR list_contains(g, i.sub_category) OR list_has_any(m, im))
SELECT l.tier, CAST(sum(CASE WHEN NOT blank AND ok.tier IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN blank OR ok.tier IS NULL THEN n ELSE 0 END) AS BIGINT) AS error,
  CAST(sum(CASE WHEN blank THEN n ELSE 0 END) AS BIGINT) AS plain_error FROM l LEFT JOIN ok ON ok.tier = l.tier AND ok.description = l.description GROUP BY l.tier"""),
)
def fitout_outcome(spark, sf):
    """Every line of every tier; a line without a match is an error in this flow, only one without a text in the others."""
    found = rate_cards.match_batch(_fit_lines(spark, sf, "p_partkey % 13 = 0"), _card(spark, sf))
    strict, plain = (hardening.outcome_counts(found, no_match_is_error=rule) for rule in (True, False))
    return strict.select("tier", "success", "error").join(plain.select("tier", F.col("error").alias("plain_error")), "tier")


def _attributes_sql(x):
    """Attributes of a text: size, rank, feature tags, naming words."""
    pattern = "(?i)([0-9]{2,4})\\s*[x*]\\s*([0-9]{2,4})"
    w, d = (f"CAST(regexp_extract({x}, '{pattern}', {i}) AS INTEGER)" for i in (1, 2))
    scale = f"CASE WHEN {w} < 250 AND {d} < 250 THEN 10 ELSE 1 END"
    size = f"""CAST(CASE WHEN {d} > {w} AND {d} * {scale} > 500 THEN {d} * {scale} ELSE {w} * {scale} END AS VARCHAR) || 'x' ||
      CAST(CASE WHEN {d} > {w} AND {d} * {scale} > 500 THEN {w} * {scale} ELSE {d} * {scale} END AS VARCHAR)"""
    rank = f"CASE {' '.join(f"WHEN regexp_matches({x}, '(?i){p}') THEN {r}" for r, p in rules.RANKS)} END"
    tags = ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){p}') THEN '{t}' END" for _, t, p in rules.FEATURES)
    words = "ws"
    return f"""CASE WHEN regexp_matches({x}, '{pattern}') THEN {size} END AS size, {rank} AS rank, list_filter([{tags}], lambda t: t IS NOT NULL) AS tags,
      list_filter(list_distinct(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda w: list_contains({words}, w)) AS words"""


def _worth(ws):
    nouns = "[" + ", ".join(f"'{n}'" for n in rules.SYNONYMS) + "]"
    return f"(len({ws}) - len(list_filter({ws}, lambda w: list_contains({nouns}, w))) * 0.5::DOUBLE)"


_RULES = [(m, s, p.replace("(?! stool)", "")) for m, s, p in rules.TAXONOMY]
_SHARED = "list_filter(l.words, lambda w: list_contains(p.words, w))"


@query(
    "attribute_match",
    V.sql_text(f"""WITH vocabulary AS (SELECT list_filter(list_distinct(regexp_extract_all(regexp_replace(p, '\\\\b|\\(\\?!.*?\\)', ' ', 'g'), '[a-z]+')), lambda w: length(w) > 2) AS ws
  FROM (SELECT '{' '.join(p for _, _, p in rules.TAXONOMY)}' AS p)),
texts AS (SELECT DISTINCT upper({V.DESCRIPTION}) AS t FROM part),
l AS (SELECT t, {_attributes_sql('t')}, list_distinct(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{m}' END" for m, _, p in _RULES)}], lambda g: g IS NOT NULL)) AS mains,
  list_distinct(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{s}' END" for _, s, p in _RULES)}], lambda g: g IS NOT NULL)) AS subs FROM texts, vocabulary),
items AS (SELECT p_partkey, {V.FURNISH} || ' ' || {V.DESCRIPTION} AS t, {V.DESCRIPTION} AS d FROM part),
p AS (SELECT p_partkey, {_attributes_sql('t')}, CASE {' '.join(f"WHEN regexp_matches(d, '(?i){p}') THEN '{m}'" for m, _, p in _RULES)} END AS main,
  CASE {' '.join(f"WHEN regexp_matches(d, '(?i){p}') THEN '{s}'" for _, s, p in _RULES)} END AS sub FROM items, vocabulary),
s AS (SELECT l.t, p.p_partkey, round(1.0::DOUBLE + CASE WHEN list_contains(l.subs, p.sub) THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN l.size = p.size THEN 2.0::DOUBLE ELSE 0 END
   + CASE WHEN len(l.words) > 0 THEN {_worth(_SHARED)} * 4.0::DOUBLE / {_worth('l.words')} ELSE 0 END
   + greatest(coalesce(abs(l.rank - p.rank), 0) - 1, 0) * -0.1::DOUBLE + len(list_filter(l.tags, lambda x: list_contains(p.tags, x))) * 0.25::DOUBLE, 6) AS score
  FROM l JOIN p ON list_contains(l.mains, p.main)),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, p_partkey) AS rn FROM s)
SELECT l.t AS description, coalesce(CASE WHEN score >= 2 THEN p_partkey END, -1) AS catalog_pos, coalesce(CASE WHEN score >= 2 THEN score END, -1.0::DOUBLE) AS confidence
FROM l LEFT JOIN r ON r.t = l.t AND rn = 1"""),
)
def attribute_match(spark, sf):
    lines = V.parts(spark, sf).select(V.on_parts(f"upper({V.DESCRIPTION})").alias("description"))
    products = V.parts(spark, sf).select(
        F.col("p_partkey").alias("catalog_pos"), F.col("fname").alias("model"), V.on_parts(V.DESCRIPTION).alias("description"),
    )
    from billwright.functions.tagging import category_of

    tagged = products.withColumn("c", category_of("description")).select(
        "catalog_pos", "model", "description", F.col("c.main").alias("main_category"), F.col("c.sub").alias("sub_category")
    )
    return attributes.match_by_attributes(lines, tagged).select(
        "description", F.coalesce("catalog_pos", F.lit(-1)).alias("catalog_pos"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence")
    )


# ------------------------------------------------------------------ hardening, history, choices
@query(
    "hardening_upsert",
    V.sql_text(f"""WITH {V.CATALOG_SQL}, {V.BRANDS_SQL}, have AS (SELECT * FROM catalog WHERE pos % 2 = 0),
d AS (SELECT CASE WHEN pos % 9 = 0 THEN 'Nobody' ELSE ' ' || upper(brand) END AS brand, tier, upper(model) AS model, pos AS seq FROM catalog),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(brand)), tier, lower(trim(model)) ORDER BY seq) AS rn FROM d),
n AS (SELECT f.*, b.brand_id FROM f JOIN brands b ON lower(trim(b.name)) = lower(trim(f.brand)) AND b.tier = f.tier WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM have h WHERE lower(trim(h.brand)) = lower(trim(f.brand)) AND h.tier = f.tier AND lower(trim(h.model)) = lower(trim(f.model))))
SELECT brand_id, model, coalesce((SELECT max(pos) FROM have h WHERE h.brand_id = n.brand_id), -1) + row_number() OVER (PARTITION BY brand_id ORDER BY seq) AS pos FROM n"""),
)
def hardening_upsert(spark, sf):
    catalog = settle(V.catalog(spark, sf), "catalog")
    have = catalog.where("pos % 2 = 0")
    found = catalog.select(
        F.when(F.col("pos") % 9 == 0, "Nobody").otherwise(F.concat(F.lit(" "), F.upper("brand"))).alias("brand"), "tier",
        F.upper("model").alias("model"), F.col("pos").alias("seq"), F.lit("ok").alias("status"),
    )
    return hardening.harden(found, have, V.brands(spark, sf), "2024-01-01 00:00:00").select("brand_id", "model", "pos")


@query(
    "enrichment_shape",
    V.sql_text(f"""SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN {V.FURNISH} ELSE 'Asked' END AS model,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Official ' || p_brand || ' Asked extracted via AI Discovery.' END AS description,
  CASE p_partkey % 4 WHEN 0 THEN 'Office Seating' WHEN 1 THEN 'Storage' ELSE 'Furniture' END AS main_category,
  CASE p_partkey % 4 WHEN 0 THEN 'Sofas' WHEN 1 THEN 'pedestals' ELSE 'Conference Tables' END AS sub_category, CAST(p_retailprice AS DOUBLE) AS price FROM part"""),
)
def enrichment_shape(spark, sf):
    details = V.table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("seq"), F.lit("Asked").alias("asked_model"),
        F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN {V.FURNISH} ELSE '' END").alias("model"), F.lit("").alias("family"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END").alias("description"), F.lit("").alias("image_url"), F.lit("").alias("website_url"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'OFFICE seating' WHEN 1 THEN 'storage' ELSE 'unheard' END").alias("main_category"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'sofas' ELSE 'odd' END").alias("sub_category"), F.col("p_retailprice").cast("string").alias("price"),
    )
    return hardening.shape_discoveries(details).select("seq", "model", "description", "main_category", "sub_category", "price")


@query(
    "match_history",
    f"""WITH {V.BOQ_SQL}, h AS (SELECT description, p_brand AS brand, p_type AS model, count(*) AS times FROM boq GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY times DESC, brand, model) AS rn FROM h)
SELECT description, brand, model, CAST(times AS BIGINT) AS times FROM r WHERE rn = 1""",
)
def match_history(spark, sf):
    matches = V.boq(spark, sf, ("brand", "p_brand"), ("model", "p_type"))
    return hardening.usual_match(hardening.match_history(matches))


CHOICE_SQL = f"""{V.CATALOG_SQL}, lv AS (SELECT *, CASE WHEN norm_category <> '' THEN norm_category ELSE main_category END AS em FROM catalog)"""


@query(
    "cascade_options",
    f"""WITH {CHOICE_SQL}
SELECT DISTINCT brand_id, 'main' AS level, '' AS main, '' AS sub, o AS option FROM (SELECT brand_id, unnest([norm_category, main_category]) AS o FROM lv) WHERE o NOT IN ('', 'null', 'undefined')
UNION ALL SELECT DISTINCT brand_id, 'sub', em, '', sub_category FROM lv UNION ALL SELECT DISTINCT brand_id, 'family', em, sub_category, family FROM lv""",
)
def cascade_options(spark, sf):
    return choices.cascade_options(V.catalog(spark, sf))


VARIANT_SQL = f"""{CHOICE_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY brand_id, em, sub_category, family,
    CASE WHEN product_url <> '' THEN product_url WHEN image_url <> '' THEN image_url ELSE 'id_' || CAST(pos AS VARCHAR) END ORDER BY pos) AS rn FROM lv),
va AS (SELECT *, row_number() OVER (PARTITION BY brand_id, em, sub_category, family, model ORDER BY pos) AS i, count(*) OVER (PARTITION BY brand_id, em, sub_category, family, model) AS n FROM u WHERE rn = 1)"""


@query(
    "variant_listing",
    f"""WITH {VARIANT_SQL} SELECT brand_id, pos, em AS main, sub_category AS sub, family, model,
  CASE WHEN product_url <> '' THEN product_url WHEN image_url <> '' THEN image_url ELSE 'model_' || model || '_' || CAST(i - 1 AS VARCHAR) END AS value,
  '[' || sub_category || '] ' || model || CASE WHEN n > 1 THEN ' (' || substring(description, 1, 25) || '...)' ELSE '' END AS label FROM va""",
)
def variant_listing(spark, sf):
    return choices.variant_options(V.catalog(spark, sf))


@query(
    "variant_lookup",
    f"""WITH {VARIANT_SQL}, s AS (SELECT pos AS sel, brand_id, em AS main, sub_category AS sub, family, model,
    CASE pos % 3 WHEN 0 THEN 'model_' || model || '_1' WHEN 1 THEN CASE WHEN image_url <> '' THEN image_url ELSE 'x' END ELSE 'model_x' END AS value FROM lv),
w AS (SELECT brand_id, v, min(pos) AS p FROM (SELECT brand_id, pos, unnest([product_url, image_url]) AS v FROM lv) WHERE v <> '' GROUP BY ALL),
tr AS (SELECT brand_id, em, sub_category, family, model, pos, row_number() OVER (PARTITION BY brand_id, em, sub_category, family, model ORDER BY pos) AS i FROM lv)
SELECT sel, coalesce(w.p, t1.pos, t0.pos) AS product_pos FROM s LEFT JOIN w ON w.brand_id = s.brand_id AND w.v = s.value
LEFT JOIN tr t1 ON t1.brand_id = s.brand_id AND t1.em = s.main AND t1.sub_category = s.sub AND t1.family = s.family AND t1.model = s.model AND t1.i = CASE WHEN sel % 3 = 0 THEN 2 ELSE 1 END
LEFT JOIN tr t0 ON t0.brand_id = s.brand_id AND t0.em = s.main AND t0.sub_category = s.sub AND t0.family = s.family AND t0.model = s.model AND t0.i = 1""",
)
def variant_lookup(spark, sf):
    products = V.catalog(spark, sf)
    effective = F.when(F.col("norm_category") != "", F.col("norm_category")).otherwise(F.col("main_category"))
    picked = products.select(
        F.col("pos").alias("sel"), "brand_id", effective.alias("main"), F.col("sub_category").alias("sub"), "family", "model",
        F.expr("CASE pos % 3 WHEN 0 THEN 'model_' || model || '_1' WHEN 1 THEN CASE WHEN image_url <> '' THEN image_url ELSE 'x' END ELSE 'model_x' END").alias("value"),
    )
    return choices.lookup_variant(picked, products).select("sel", "product_pos")


@query(
    "auto_select",
    f"""WITH {CHOICE_SQL}, mains AS (SELECT brand_id, CASE WHEN count(DISTINCT o) = 1 THEN min(o) END AS one FROM (SELECT brand_id || '/' || sub_category AS brand_id, unnest([norm_category, main_category]) AS o FROM lv) WHERE o NOT IN ('', 'null', 'undefined') GROUP BY 1),
r AS (SELECT DISTINCT brand_id || '/' || sub_category AS brand_id FROM lv),
a AS (SELECT r.brand_id, coalesce(one, '') AS m FROM r LEFT JOIN mains USING (brand_id)),
x AS (SELECT brand_id || '/' || sub_category AS brand_id, em, sub_category, family, model, pos, price, CASE WHEN product_url <> '' THEN product_url WHEN image_url <> '' THEN image_url ELSE 'id_' || CAST(pos AS VARCHAR) END AS uid FROM lv),
b AS (SELECT a.*, coalesce((SELECT CASE WHEN count(DISTINCT sub_category) = 1 THEN min(sub_category) END FROM x WHERE x.brand_id = a.brand_id AND x.em = a.m AND a.m <> ''), '') AS s FROM a),
c AS (SELECT b.*, coalesce((SELECT CASE WHEN count(DISTINCT family) = 1 THEN min(family) END FROM x WHERE x.brand_id = b.brand_id AND x.em = b.m AND x.sub_category = b.s AND b.s <> ''), '') AS f FROM b),
d AS (SELECT c.*, (SELECT CASE WHEN count(DISTINCT uid) = 1 THEN min(pos) END FROM x WHERE x.brand_id = c.brand_id AND x.em = c.m AND x.sub_category = c.s AND x.family = c.f AND c.f <> '') AS p FROM c)
SELECT d.brand_id, m AS selected_main_cat, s AS selected_sub_cat, f AS selected_family, coalesce(x.model, '') AS selected_model, coalesce(CAST(round(x.price, 2) AS DOUBLE), -1) AS rate,
  coalesce(CAST(round(x.price * 3, 2) AS DOUBLE), -1) AS amount FROM d LEFT JOIN x ON x.brand_id = d.brand_id AND x.pos = d.p""",
)
def auto_select(spark, sf):
    products = V.catalog(spark, sf).withColumn("brand_id", F.concat_ws("/", "brand_id", "sub_category"))
    blank = [F.lit("").alias(c) for c in ("selected_main_cat", "selected_sub_cat", "selected_family", "selected_model", "selected_model_url", "rate", "amount", "unit")]
    rows = products.select("brand_id").distinct().select("brand_id", F.lit("3").alias("qty"), *blank)
    out = choices.auto_select(rows, products)
    return out.select(
        "brand_id", "selected_main_cat", "selected_sub_cat", "selected_family", "selected_model",
        F.coalesce(F.col("rate").cast("double"), F.lit(-1.0)).alias("rate"), F.coalesce(F.col("amount").cast("double"), F.lit(-1.0)).alias("amount"),
    )


@query(
    "history_suggestions",
    f"""WITH {V.BOQ_SQL}, h AS (SELECT description, p_brand AS brand, p_type AS model, count(*) AS times FROM boq GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY times DESC, brand, model) AS rn FROM h),
u AS (SELECT {V.key_sql('description')} AS k, brand, model, times, row_number() OVER (PARTITION BY {V.key_sql('description')} ORDER BY times DESC, brand DESC, model DESC) AS rk FROM r WHERE rn = 1)
SELECT doc_id, sn, u.brand AS usual_brand, u.model AS usual_model, CAST(u.times AS BIGINT) AS times FROM boq b LEFT JOIN u ON u.k = {V.key_sql('b.description')} AND rk = 1""",
)
def history_suggestions(spark, sf):
    history = hardening.match_history(V.boq(spark, sf, ("brand", "p_brand"), ("model", "p_type")))
    lines = V.numbered_boq(spark, sf).select("doc_id", "sn", F.upper("description").alias("description"))
    return hardening.remembered(lines, history).select("doc_id", "sn", "usual_brand", "usual_model", "times")


