"""Sheets, line items, costing and registers."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import clean_quantity, display, money, parse_number
from billwright.functions.text import enriched_description
from billwright.operators import costing, plan_items, registers, sheets
from billwright.operators.settle import settle
from billwright.plans.boq_costing import cost_documents, structure, summary_of_cells
from billwright.queries import views as V
from billwright.queries.registry import query

FACTORS = costing.factors(**V.FACTORS)
MULT = f"CAST('{FACTORS['multiplier']}' AS DECIMAL(12,8))"
CATALOG_PRICE = ("base_price", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,4)) END")


# ------------------------------------------------------------------ flagship
@query(
    "costed_totals",
    f"""WITH {V.BOQ_SQL}, costed AS (
  SELECT doc_id, round(CAST(amount AS DECIMAL(18,4)) * {MULT}, 2) AS amount FROM boq)
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(amount) AS DOUBLE) AS subtotal,
  CAST(round(CAST(sum(amount) AS DECIMAL(24,8)) * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) AS vat_amount,
  CAST(round(CAST(sum(amount) AS DECIMAL(24,8)) + CAST(sum(amount) AS DECIMAL(24,8)) * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) AS grand_total,
  'OMR' AS currency
FROM costed GROUP BY doc_id""",
)
def costed_totals(spark, sf):
    rows = V.boq(spark, sf)
    costed = rows.withColumn("amount", money(F.col("amount") * F.lit(FACTORS["multiplier"]).cast(costing.FACTOR)))
    return costing.totals(costed, FACTORS)


@query(
    "row_markup_offer",
    V.sql_text(f"""WITH {V.BOQ_SQL}, base AS (
  SELECT *, {CATALOG_PRICE[1]} AS base_price FROM boq), marked AS (
  SELECT doc_id, sn, description, qty, unit,
    CASE WHEN base_price > 0 THEN CAST(round(base_price * {MULT}, 2) AS DECIMAL(18,2)) ELSE CAST(rate AS DECIMAL(18,4)) END AS rate,
    CASE WHEN base_price > 0 THEN round(CAST(base_price * {MULT} AS DECIMAL(24,8)) * CAST(qty AS DECIMAL(12,4)), 2) ELSE amount END AS amount
  FROM base)
SELECT doc_id, sn, description || ' | Qty: ' || CAST(qty AS VARCHAR) || CASE WHEN unit <> '' THEN ', Unit: ' || unit ELSE '' END AS description,
  CAST(qty AS DOUBLE) AS qty, CASE WHEN unit = '' THEN 'Nos' ELSE unit END AS unit, CAST(rate AS DOUBLE) AS rate,
  CAST(round(amount, 2) AS DOUBLE) AS amount FROM marked"""),
)
def row_markup_offer(spark, sf):
    rows = V.numbered_boq(spark, sf, CATALOG_PRICE).withColumn(
        "brand_desc", enriched_description("description", "qty", "unit")
    ).withColumn("brand_image", F.lit("")).withColumn("image_ref", F.lit(None).cast("string"))
    offer = costing.offer(costing.row_markup(rows, FACTORS))
    return offer.select(
        "doc_id", "sn", "description", F.col("qty").cast("double").alias("qty"), "unit",
        F.col("rate").cast("double").alias("rate"), "amount",
    )


@query(
    "display_format",
    V.sql_text(f"""WITH {V.BOQ_SQL}, v AS (SELECT doc_id, sn, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS a, CAST(CAST(qty AS INTEGER) AS VARCHAR) AS q, description FROM boq)
SELECT doc_id, sn, regexp_replace(format('{{:,.3f}}', CAST(a AS DOUBLE)), '(\\.[0-9][0-9])0$', '\\1') AS amount_text,
  format('{{:,}}', CAST(q AS INTEGER)) AS qty_text, description AS description_text FROM v"""),
)
def display_format(spark, sf):
    rows = V.numbered_boq(spark, sf)
    return rows.select(
        "doc_id", "sn",
        display(F.col("amount").cast("decimal(18,2)").cast("string"), F.lit("Total Amount")).alias("amount_text"),
        display(F.col("qty").cast("int").cast("string"), F.lit("Qty")).alias("qty_text"),
        display("description", F.lit("Description")).alias("description_text"),
    )


RATES = ", ".join(f"('{c}', CAST('{r}' AS DECIMAL(12,6)))" for c, r in rules.USD_RATES.items())


@query(
    "fx_rates",
    f"""WITH fx(code, rate) AS (VALUES {RATES}), pairs AS (
  SELECT DISTINCT CASE c_custkey % 12 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(rules.USD_RATES))} ELSE 'XXX' END AS f,
    CASE c_nationkey % 12 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(rules.USD_RATES))} ELSE 'XXX' END AS t FROM customer)
SELECT f AS from_currency, t AS to_currency, CASE WHEN f = t THEN 1.0 ELSE CAST(CAST(
  (CAST(coalesce(b.rate, 1) * 1000000 AS HUGEINT) * 20000 + CAST(coalesce(a.rate, 1) * 1000000 AS HUGEINT)) // (2 * CAST(coalesce(a.rate, 1) * 1000000 AS HUGEINT)) AS DECIMAL(18,0)) * CAST('0.0001' AS DECIMAL(5,4)) AS DOUBLE) END AS rate
FROM pairs LEFT JOIN fx a ON a.code = f LEFT JOIN fx b ON b.code = t""",
)
def fx_rates(spark, sf):
    codes = F.array(*[F.lit(c) for c in rules.USD_RATES])
    code = lambda c: F.coalesce(F.get(codes, (F.col(c) % 12).cast("int")), F.lit("XXX"))
    pairs = V.table(spark, sf, "customer").select(code("c_custkey").alias("from_currency"), code("c_nationkey").alias("to_currency")).distinct()
    return pairs.withColumn("rate", costing.fx_rate("from_currency", "to_currency"))


@query(
    "amount_rules",
    V.sql_text(f"""WITH {V.BOQ_SQL}, q AS (SELECT doc_id, sn, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(qty AS VARCHAR) END AS qty, rate, CAST(p_retailprice AS DECIMAL(18,4)) AS price FROM boq)
SELECT doc_id, sn, coalesce(CAST(round({V.number_sql('qty')} * rate, 2) AS DOUBLE), -1) AS amount,
  CAST(CASE WHEN qty = '' THEN ceil(price) ELSE {V.number_sql('qty')} * CAST(ceil(price) AS DECIMAL(18,0)) END AS DOUBLE) AS fitout_amount FROM q"""),
)
def amount_rules(spark, sf):
    rows = V.numbered_boq(spark, sf, ("price", "CAST(p_retailprice AS DECIMAL(18,4))"), ("_blank", "p_partkey % 9 = 0"))
    rows = rows.withColumn("qty", F.when(F.col("_blank"), "").otherwise(F.col("qty").cast("string")))
    return rows.select(
        "doc_id", "sn",
        F.coalesce(costing.amount_of().cast("double"), F.lit(-1.0)).alias("amount"),
        costing.fitout_amount().alias("fitout_amount"),
    )


TOTAL_TEXT = V.sql_text("""SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(round(s, 2) AS DOUBLE) AS subtotal,
  CAST(round(s * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) AS vat_amount FROM""")


@query(
    "total_bases",
    V.sql_text(f"""WITH {V.BOQ_SQL}, q AS (SELECT doc_id, qty * CAST(rate AS DECIMAL(18,2)) AS product,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE amount END AS stored FROM boq),
s AS (SELECT doc_id, CAST(sum(coalesce(stored, product)) AS DECIMAL(24,8)) AS a, CAST(sum(product) AS DECIMAL(24,8)) AS b, count(*) AS n FROM q GROUP BY doc_id)
SELECT doc_id, 'stored_else_product' AS basis, CAST(n AS BIGINT) AS lines, CAST(round(a, 2) AS DOUBLE) AS subtotal,
  CAST(round(a + a * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) AS grand_total FROM s
UNION ALL SELECT doc_id, 'product', CAST(n AS BIGINT), CAST(round(b, 2) AS DOUBLE), CAST(round(b + b * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) FROM s"""),
)
def total_bases(spark, sf):
    rows = V.boq(spark, sf, ("_blank", "p_partkey % 4 = 0")).withColumn("rate", F.col("rate").cast("decimal(18,2)"))
    rows = rows.withColumn("amount", F.when(~F.col("_blank"), F.col("amount")))
    parts = [
        costing.totals(rows, FACTORS, basis=b).select("doc_id", F.lit(b).alias("basis"), "lines", "subtotal", "grand_total")
        for b in ("stored_else_product", "product")
    ]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ sheets
@query(
    "header_detect",
    f"""WITH {V.CELLS_SQL}, {V.SHEET_ROWS_SQL}
SELECT h.doc_id, h.sheet_id, CAST(h.row_no AS INTEGER) AS header_row, CAST(h.width AS INTEGER) AS header_width,
  string_agg(c.value, '|' ORDER BY c.col_no) AS header
FROM headers h JOIN cells c USING (doc_id, sheet_id, row_no) GROUP BY ALL""",
)
def header_detect(spark, sf):
    found = V.by_document_size(spark, sf, lambda lines, whole: sheets.header_rows(sheets.sheet_rows(V.row_pieces(spark, sf, lines, whole))))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("header")), lambda e: e["value"]), "|")
    return found.select("doc_id", "sheet_id", "header_row", "header_width", text.alias("header"))


def _from_sheets(spark, sf, build, **how):
    """``build(header, table, whole)`` over the structured sheets, apart for documents too large for a task."""
    return V.by_document_size(spark, sf, lambda lines, whole: build(*structure(V.row_pieces(spark, sf, lines, whole), whole=whole, **how), whole))


def _row_text():
    return F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda e: e["value"]), "|")


def _stitched_sql(drop):
    return f"""WITH {V.CELLS_SQL}, {V.SHEET_ROWS_SQL}, {V.body_sql(drop)}
SELECT n.doc_id, n.row_idx, n.sheet_id AS sheet_order, CAST(n.row_no AS INTEGER) AS row_no, string_agg(b.value, '|' ORDER BY b.col_no) AS row_text
FROM numbered n JOIN body b USING (doc_id, sheet_id, row_no) GROUP BY ALL"""


@query("sheet_stitch", _stitched_sql(True))
def sheet_stitch(spark, sf):
    return _from_sheets(spark, sf, lambda _, table, whole: table.select("doc_id", "row_idx", "sheet_order", "row_no", _row_text().alias("row_text")))


@query("legacy_stitch", _stitched_sql(False))
def legacy_stitch(spark, sf):
    texts = lambda _, table, whole: table.select("doc_id", "row_idx", "sheet_order", "row_no", _row_text().alias("row_text"))
    return _from_sheets(spark, sf, texts, drop_repeated=False, keep_images=False)


@query(
    "column_roles",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql(V.ROLE_COND, 2)}, {V.roles_sql(V.VIEWER_COND, name='viewer')}
SELECT doc_id, coalesce(r.description_col, -1) AS description_col, coalesce(r.qty_col, -1) AS qty_col, coalesce(r.unit_col, -1) AS unit_col,
  coalesce(r.rate_col, -1) AS rate_col, coalesce(r.amount_col, -1) AS amount_col,
  coalesce(v.rate_col, -1) AS viewer_rate_col, coalesce(v.amount_col, -1) AS viewer_amount_col, coalesce(v.description_col, -1) AS viewer_description_col,
  coalesce(v.image_col, -1) AS viewer_image_col FROM roles r JOIN viewer v USING (doc_id)""",
)
def column_roles(spark, sf):
    return _from_sheets(spark, sf, _both_roles)


def _both_roles(header, table, whole):
    viewer = ("rate_col", "amount_col", "description_col", "image_col")
    every = header.where(F.size("header") > 0).select("doc_id", F.struct(*sheets.role_columns(rules.OFFER_ROLES, 2)).alias("o"), F.struct(*sheets.role_columns(rules.VIEWER_ROLES)).alias("v"))
    joined = every.select("doc_id", "o.*", *[F.col(f"v.{c}").alias(f"viewer_{c}") for c in viewer])
    return joined.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in joined.columns if c != "doc_id"])


@query(
    "boq_pivot",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql(V.ROLE_COND, 2)}, {V.role_values_sql(['description', 'qty', 'unit', 'rate', 'amount'])}
SELECT doc_id, row_idx AS sn, description, qty, unit, rate, amount FROM vals""",
)
def boq_pivot(spark, sf):
    def build(header, table, whole):
        rows = sheets.boq_rows(sheets.with_roles(table, header, rules.OFFER_ROLES, default_description=2))
        return rows.select("doc_id", "sn", "description", "qty", "unit", "rate", "amount")

    return _from_sheets(spark, sf, build)


VE_COND = V.ROLE_COND | {"description": ["regexp_matches(title, '(?i)description|desc|disc|item|product')"]}


@query(
    "ve_boq_rows",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql(VE_COND)}, {V.role_values_sql(['description', 'qty', 'unit', 'rate', 'amount'])}
SELECT doc_id, row_idx AS sn, trim(description) AS description, trim(qty) AS qty, trim(unit) AS unit, trim(rate) AS rate, trim(amount) AS amount FROM vals WHERE row_idx % 5 <> 4""",
)
def ve_boq_rows(spark, sf):
    """The value-engineering variant: more names for descriptions, trimmed cells, no rows marked as headers or summaries."""
    def build(header, table, whole):
        marked = table.withColumns({"is_header": F.col("row_idx") % 5 == 4, "is_summary": F.lit(None).cast("boolean")})
        rows = sheets.boq_rows(sheets.with_roles(marked, header, rules.VALUE_ENGINEERING_ROLES), trim=True, drop_special=True)
        return rows.select("doc_id", "sn", "description", "qty", "unit", "rate", "amount")

    return _from_sheets(spark, sf, build)


@query(
    "extracted_summary",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql(V.VIEWER_COND)}, {V.role_values_sql(['qty', 'rate', 'unit', 'amount'])}, s AS (
  SELECT doc_id, sum({V.number_sql('rate')}) FILTER (qty <> '' OR rate <> '' OR unit <> '') AS r,
    sum({V.number_sql('amount')}) FILTER (qty <> '' OR rate <> '' OR unit <> '') AS a,
    sum({V.number_sql('qty')}) FILTER (qty <> '' OR rate <> '' OR unit <> '') AS q,
    count({V.number_sql('amount')}) FILTER (qty <> '' OR rate <> '' OR unit <> '') AS n FROM vals GROUP BY doc_id)
SELECT doc_id, CAST(round(coalesce(r, 0), 2) AS DOUBLE) AS total_rate, CAST(round(coalesce(a, 0), 2) AS DOUBLE) AS total_amount,
  CAST(round(coalesce(q, 0), 0) AS BIGINT) AS total_qty, CAST(n AS BIGINT) AS item_count
FROM s WHERE coalesce(a, 0) > 0 OR coalesce(r, 0) > 0""",
)
def extracted_summary(spark, sf):
    summed = V.by_document_size(spark, sf, lambda lines, whole: summary_of_cells(V.row_pieces(spark, sf, lines, whole), whole))
    return summed.where("total_amount is not null")


MONEY_SQL = f"(regexp_matches(title, '(?i)rate|price') OR {V.AMOUNT_OR_TOTAL})"


@query(
    "table_costing",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql(V.ROLE_COND, 2)}, money_cols AS (SELECT doc_id, col_no FROM head WHERE {MONEY_SQL}),
costed AS (SELECT n.doc_id, n.row_idx, b.col_no, CASE WHEN m.col_no IS NOT NULL AND {V.number_sql('b.value')} IS NOT NULL
    THEN CAST(CAST(round({V.number_sql('b.value')} * {MULT}, 2) AS DECIMAL(18,2)) AS VARCHAR) ELSE b.value END AS value
  FROM numbered n JOIN body b USING (doc_id, sheet_id, row_no) LEFT JOIN money_cols m ON m.doc_id = n.doc_id AND m.col_no = b.col_no),
amounts AS (SELECT c.doc_id, c.row_idx, coalesce(max(CASE WHEN c.col_no = r.amount_col THEN value END), '') AS a FROM costed c JOIN roles r ON r.doc_id = c.doc_id GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n, CAST(sum(coalesce({V.number_sql('a')}, 0)) AS DECIMAL(24,8)) AS s FROM amounts GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS lines, CAST(round(s, 2) AS DOUBLE) AS subtotal, CAST(round(s * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) AS vat_amount,
  CAST(round(s + s * CAST('0.05' AS DECIMAL(8,6)), 2) AS DOUBLE) AS grand_total, 'OMR' AS currency FROM t""",
)
def table_costing(spark, sf):
    return V.by_document_size(spark, sf, lambda lines, whole: cost_documents(V.row_pieces(spark, sf, lines, whole), FACTORS, whole=whole)["totals"])


@query(
    "image_attach",
    V.sql_text(f"""WITH {V.CELLS_SQL}, pics AS (
  SELECT doc_id, sheet_id, row_no, col_no, i AS ord, 'img/' || CAST(doc_id AS VARCHAR) || '-' || CAST(row_no AS VARCHAR) || '-' || CAST(i AS VARCHAR) || '.png' AS url
  FROM cells, LATERAL (SELECT unnest(range(0, 2)) AS i) WHERE col_no = 2 AND row_no BETWEEN 11 AND 100000 AND row_no % 3 <> 0 AND i <= row_no % 2)
SELECT doc_id, sheet_id, CAST(row_no AS INTEGER) AS row_no, '/' || min(url) AS image_ref, CAST(count(*) AS BIGINT) AS images FROM pics GROUP BY ALL"""),
)
def image_attach(spark, sf):
    cells = V.cells(spark, sf)
    pics = cells.where("col_no = 2 and row_no between 11 and 100000 and row_no % 3 <> 0").select(
        "doc_id", "sheet_id", "row_no", "col_no", F.explode(F.sequence(F.lit(0), F.col("row_no") % 2)).alias("ord")
    ).withColumn("url", F.concat_ws("-", F.concat(F.lit("img/"), "doc_id"), "row_no", "ord")).withColumn(
        "url", F.concat("url", F.lit(".png"))
    ).withColumn("extension", F.lit("png"))
    rows = sheets.sheet_rows(cells, pics).where("images is not null")
    return rows.select(
        "doc_id", "sheet_id", "row_no", sheets.row_image().alias("image_ref"),
        F.aggregate(F.map_values("images"), F.lit(0), lambda a, l: a + F.size(l)).cast("bigint").alias("images"),
    )


SECTION_TEXT = ("section_text", "CASE p_partkey % 8 WHEN 0 THEN 'LIST OF FURNITURE' WHEN 1 THEN 'total amount' WHEN 2 THEN '[FL-01] Carpet' "
                "WHEN 3 THEN '  ' WHEN 4 THEN 'Area of works' WHEN 5 THEN 'HEAD OF CHAIR' WHEN 6 THEN 'Item  no' ELSE p_name END")
SECTION_QTY = ("section_qty", "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) ELSE '' END")


def _section_sql(words, rate):
    text = "lower(trim(section_text))"
    starts = " OR ".join(f"{text} = '{w}' OR starts_with({text}, '{w} ')" for w in words)
    data = "section_qty <> ''" + (" OR section_rate <> ''" if rate else "")
    return f"""CASE WHEN {text} = '' THEN true WHEN regexp_matches({text}, '^\\[.*?\\]') THEN false WHEN {data} THEN false
  ELSE ({starts}) OR regexp_matches({text}, '{rules.SECTION_EXACT}') OR regexp_matches({text}, '{rules.SECTION_LIST_OF}') END"""


@query(
    "section_headers",
    V.sql_text(f"""WITH {V.BOQ_SQL}, t AS (SELECT doc_id, sn, {SECTION_TEXT[1]} AS section_text, {SECTION_QTY[1]} AS section_qty,
  CASE WHEN p_size % 5 = 0 THEN '9.5' ELSE '' END AS section_rate FROM boq)
SELECT doc_id, sn, {_section_sql(rules.SECTION_WORDS, True)} AS is_section, {_section_sql(rules.SECTION_WORDS_SHORT, False)} AS is_section_short FROM t"""),
)
def section_headers(spark, sf):
    rows = V.numbered_boq(spark, sf, SECTION_TEXT, SECTION_QTY, ("section_rate", "CASE WHEN p_size % 5 = 0 THEN '9.5' ELSE '' END"))
    rows = rows.withColumn("no_unit", F.lit(""))
    return rows.select(
        "doc_id", "sn",
        sheets.is_section("section_text", "section_qty", "no_unit", "section_rate").alias("is_section"),
        sheets.is_section("section_text", "section_qty", "no_unit", words=rules.SECTION_WORDS_SHORT).alias("is_section_short"),
    )


STATUS = ("ai_status", "CASE WHEN p_partkey % 5 = 0 THEN 'success' ELSE 'idle' END")
CHOSEN = ("selected_brand", "CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END")


@query(
    "work_selection",
    V.sql_text(f"""WITH {V.BOQ_SQL}, t AS (SELECT doc_id, sn, scope, {STATUS[1]} AS ai_status, {CHOSEN[1]} AS selected_brand FROM boq)
SELECT doc_id, sn, 'furniture' AS kind FROM t WHERE scope <> 'Fitout' AND ai_status <> 'success'
UNION ALL SELECT doc_id, sn, 'fitout' FROM t WHERE scope = 'Fitout' AND selected_brand = ''
UNION ALL SELECT doc_id, sn, 'value_engineering' FROM t WHERE ai_status <> 'success'"""),
)
def work_selection(spark, sf):
    rows = V.numbered_boq(spark, sf, STATUS, CHOSEN)
    parts = [sheets.work_rows(rows, k).select("doc_id", "sn", F.lit(k).alias("kind")) for k in ("furniture", "fitout", "value_engineering")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EXTRACTED = [
    ("raw_sn", "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'undefined.1' ELSE CAST(p_size AS STRING) END"),
    ("raw_text", "CASE WHEN p_partkey % 10 = 0 THEN 'Description Qty ' || p_name ELSE p_name END"),
    ("raw_qty", "CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '12 Nos' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"),
]


@query(
    "extracted_shape",
    V.sql_text(f"""WITH {V.BOQ_SQL}, t AS (SELECT doc_id, l_linenumber AS page_num, sn AS row_idx, {EXTRACTED[0][1]} AS raw_sn, {EXTRACTED[1][1]} AS raw_text,
    {EXTRACTED[2][1].replace('l_quantity', 'qty')} AS raw_qty, unit, rate FROM boq),
f AS (SELECT *, trim(raw_sn) <> '' AND raw_sn NOT LIKE '%undefined%' AS ok FROM t),
g AS (SELECT *, CASE WHEN ok THEN trim(raw_sn) ELSE CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_num, row_idx) AS VARCHAR) END AS sn FROM f)
SELECT doc_id, page_num, row_idx, sn, raw_text AS description,
  CASE WHEN coalesce(TRY_CAST(raw_qty AS INTEGER), 0) = 0 THEN '' ELSE raw_qty END AS qty, unit FROM g
WHERE NOT (contains(lower(raw_text), 'description') AND contains(lower(raw_text), 'qty'))"""),
)
def extracted_shape(spark, sf):
    rows = V.numbered_boq(spark, sf, *EXTRACTED).select(
        "doc_id", F.col("l_linenumber").alias("page_num"), F.col("sn").alias("row_idx"), F.col("raw_sn").alias("sn"),
        F.col("raw_text").alias("description"), F.col("raw_qty").alias("qty"), "unit", "rate", "amount",
    )
    filled = sheets.drop_extracted_headers(sheets.fill_serial_numbers(rows))
    return sheets.shape_seven_columns(filled).select("doc_id", "page_num", "row_idx", "sn", "description", "qty", "unit")


@query(
    "positional_import",
    V.sql_text(f"""WITH {V.CATALOG_SQL}, t AS (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN 'n/a' ELSE 'OMR ' || CAST(price AS VARCHAR) END AS price_text FROM catalog)
SELECT brand AS doc_id, pos + 2 AS row_no, trim(main_category) AS main_category, trim(model) AS model, image_url,
  CAST(coalesce(TRY_CAST(regexp_replace(price_text, '[^0-9.-]+', '', 'g') AS DECIMAL(18,4)), 0) AS DOUBLE) AS price, product_url FROM t"""),
)
def positional_import(spark, sf):
    from billwright.queries.views import catalog

    rows = catalog(spark, sf).withColumn(
        "price_text", F.expr("CASE WHEN pos % 6 = 0 THEN 'n/a' ELSE 'OMR ' || CAST(price AS STRING) END")
    )
    columns = ["main_category", "sub_category", "family", "model", "description", "image_url", "price_text", "product_url"]
    cells = rows.select(
        F.col("brand").alias("doc_id"), F.lit(1).alias("sheet_id"), (F.col("pos") + 2).alias("row_no"),
        F.explode(F.array(*[F.struct(F.lit(i + 1).alias("col_no"), F.col(c).alias("value")) for i, c in enumerate(columns)])).alias("c"),
    ).select("doc_id", "sheet_id", "row_no", "c.*")
    return sheets.positional_products(cells).select("doc_id", "row_no", "main_category", "model", "image_url", "price", "product_url")


# ------------------------------------------------------------------ plan items
PLAN = [
    ("raw_qty", "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'two' WHEN 2 THEN '12 Nos' WHEN 3 THEN 'some' ELSE CAST(p_size AS STRING) END"),
    ("raw_location", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' Room ' || CAST(l_suppkey % 12 AS STRING) END"),
    ("raw_text", "CASE WHEN p_partkey % 3 = 0 THEN '[Old] [Zone] ' || p_name ELSE p_name END"),
    ("file", "'plan-' || CAST(l_linenumber % 3 AS STRING)"),
]
PLAN_SQL = V.sql_text(f"""plan AS (SELECT doc_id, sn, {PLAN[3][1]} AS file, trim(CASE WHEN p_partkey % 5 = 0 THEN 'General Area' ELSE {PLAN[1][1]} END) AS location,
   {PLAN[2][1]} AS description, unit,
   CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 12 WHEN 3 THEN 1 ELSE p_size END AS qty FROM boq),
files AS (SELECT doc_id, count(DISTINCT file) AS n FROM plan GROUP BY doc_id),
tagged AS (SELECT p.*, CASE WHEN n > 1 THEN location || ' (' || file || ')' ELSE location END AS room FROM plan p JOIN files USING (doc_id))""")


def _plan(spark, sf, numbered=True):
    lines = V.numbered_boq(spark, sf, *PLAN) if numbered else V.boq(spark, sf, *PLAN)
    rows = lines.select(
        "doc_id", *(["sn"] if numbered else []), "file", F.col("raw_location").alias("location"), F.lit("").alias("scope"), F.lit(None).cast("string").alias("code"),
        F.col("raw_text").alias("description"), F.col("raw_qty").alias("qty"), "unit",
    )
    return plan_items.union_plans(plan_items.default_plan_items(rows))


@query(
    "plan_rows",
    f"""WITH {V.BOQ_SQL}, {PLAN_SQL}
SELECT doc_id, sn, '[' || room || '] ' || trim(regexp_replace(description, '^(\\[.*?\\]\\s*)+', '')) AS description, CAST(qty AS DOUBLE) AS qty,
  CASE WHEN unit = '' THEN 'Nos' ELSE unit END AS unit, 'Furniture' AS scope FROM tagged""",
)
def plan_rows(spark, sf):
    return plan_items.plan_rows(_plan(spark, sf)).select("doc_id", "sn", "description", "qty", "unit", "scope")


@query(
    "plan_totals",
    f"""WITH {V.BOQ_SQL}, {PLAN_SQL}
SELECT doc_id, CAST(count(*) AS BIGINT) AS item_count, CAST(count(DISTINCT room) AS BIGINT) AS room_count, CAST(sum(qty) AS DOUBLE) AS total_qty FROM tagged GROUP BY doc_id""",
)
def plan_totals(spark, sf):
    return plan_items.plan_totals(_plan(spark, sf, numbered=False))


@query(
    "tier_replication",
    f"""WITH {V.BOQ_SQL}, have AS (SELECT DISTINCT doc_id, 'mid' AS tier FROM boq WHERE doc_id % 4 = 0)
SELECT b.doc_id, b.sn, t.tier, b.description FROM boq b CROSS JOIN (VALUES ('budgetary'), ('mid'), ('high')) t(tier)
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.doc_id = b.doc_id AND h.tier = t.tier)""",
)
def tier_replication(spark, sf):
    rows = V.numbered_boq(spark, sf).select("doc_id", "sn", "description")
    present = rows.where("doc_id % 4 = 0").select("doc_id", F.lit("mid").alias("tier"))
    return plan_items.replicate_tiers(rows, present=present).select("doc_id", "sn", "tier", "description")


CONTOUR = """SELECT l_orderkey % 500 AS plan_id, l_linenumber + 10 * l_partkey AS id, CAST(l_partkey % 90 AS INT) + 1 AS w, CAST(l_suppkey % 60 AS INT) + 1 AS h,
  l_extendedprice AS area, CAST(l_quantity AS INT) % 11 AS sides FROM lineitem"""
LABEL = f"""SELECT l_orderkey % 500 AS plan_id, CASE l_partkey % 6 WHEN 0 THEN 'Office ' || CAST(l_suppkey AS STRING) WHEN 1 THEN '2.4 m' WHEN 2 THEN 'desk'
  WHEN 3 THEN 'lounge chair' WHEN 4 THEN 'north' ELSE '12''' END AS text, l_discount AS confidence FROM lineitem"""
ASPECT = "CASE WHEN h > 0 THEN CAST(w AS DOUBLE) / h ELSE 0 END"
ELEMENTS_SQL = V.sql_text(f"""contours AS ({CONTOUR}), labels_ AS ({LABEL}), typed AS (
  SELECT plan_id, CASE WHEN sides >= 4 AND {ASPECT} > 0.3 AND {ASPECT} < 3.0 THEN
      CASE WHEN area > 500 AND area < 50000 THEN CASE WHEN {ASPECT} > 1.5 THEN 'window' WHEN {ASPECT} < 0.7 THEN 'door' ELSE 'furniture' END ELSE 'unknown' END
    WHEN sides <= 3 AND ({ASPECT} > 5 OR {ASPECT} < 0.2) THEN 'wall' WHEN sides > 8 THEN 'fixture' ELSE 'unknown' END AS type, 'contour' AS source
  FROM contours WHERE area >= 100
  UNION ALL SELECT plan_id, CASE WHEN regexp_matches(upper(text), 'OFFICE|ROOM|AREA|LOUNGE|KITCHEN|BATHROOM') THEN 'room'
    WHEN regexp_matches(text, '(?i)^[0-9]+(\\.[0-9]+)?\\s*(m|mm|cm|ft|in|''|")') THEN 'dimension'
    WHEN regexp_matches(upper(text), 'CHAIR|TABLE|DESK|SOFA|BED|CABINET') THEN 'furniture' ELSE 'unknown' END, 'ocr' FROM labels_)""")


def _elements(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    contours = lines.selectExpr(
        "l_orderkey % 500 AS plan_id", "l_linenumber + 10 * l_partkey AS id", "CAST(l_partkey % 90 AS INT) + 1 AS w",
        "CAST(l_suppkey % 60 AS INT) + 1 AS h", "l_extendedprice AS area", "CAST(l_quantity AS INT) % 11 AS sides",
    )
    labels = lines.selectExpr(
        "l_orderkey % 500 AS plan_id",
        "CASE l_partkey % 6 WHEN 0 THEN 'Office ' || CAST(l_suppkey AS STRING) WHEN 1 THEN '2.4 m' WHEN 2 THEN 'desk' "
        "WHEN 3 THEN 'lounge chair' WHEN 4 THEN 'north' ELSE \"12'\" END AS text",
        "l_discount AS confidence",
    )
    return plan_items.plan_elements(contours, labels)


@query(
    "plan_features",
    f"WITH {ELEMENTS_SQL} SELECT plan_id, type, source, CAST(count(*) AS BIGINT) AS n FROM typed WHERE type <> 'unknown' GROUP BY ALL",
)
def plan_features(spark, sf):
    return _elements(spark, sf).groupBy("plan_id", "type", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "baseline_boq",
    f"""WITH {ELEMENTS_SQL}, c AS (SELECT plan_id, type, count(*) AS n FROM typed WHERE type <> 'unknown' GROUP BY ALL)
SELECT plan_id, 'FRN-001' AS code, CAST(greatest(1, n // 2) AS BIGINT) AS qty FROM c WHERE type = 'room'
UNION ALL SELECT plan_id, 'FRN-002', CAST(greatest(2, n) AS BIGINT) FROM c WHERE type = 'room'
UNION ALL SELECT plan_id, 'FIT-001', CAST(n AS BIGINT) FROM c WHERE type = 'door'
UNION ALL SELECT plan_id, 'FIT-002', CAST(n AS BIGINT) FROM c WHERE type = 'window'""",
)
def baseline_boq(spark, sf):
    return plan_items.baseline_items(_elements(spark, sf)).select("plan_id", "code", "qty")


@query(
    "row_edits",
    V.sql_text(f"""WITH {V.BOQ_SQL}, e AS (SELECT *, p_partkey % 6 AS a FROM boq), kept AS (
  SELECT doc_id, sn, 0 AS af, description, CASE WHEN a = 1 THEN '7' ELSE CAST(qty AS VARCHAR) END AS qty, unit, CAST(rate AS VARCHAR) AS rate,
    CASE WHEN a = 1 THEN CAST(CAST(round(7 * rate, 2) AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(amount AS VARCHAR) END AS amount FROM e WHERE a <> 2
  UNION ALL SELECT doc_id, sn, 1, '', '', '', '', '' FROM e WHERE a = 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sn, af) AS INTEGER) AS sn, description, qty, unit, rate, amount FROM kept"""),
)
def row_edits(spark, sf):
    rows = settle(V.numbered_boq(spark, sf, ("a", "p_partkey % 6")).select("doc_id", "sn", "description", "qty", "unit", "rate", "amount", "a"), "rows")
    action = F.when(F.col("a") == 1, "edit").when(F.col("a") == 2, "remove").when(F.col("a") == 3, "insert")
    edits = rows.select(
        "doc_id", "sn", action.alias("action"), F.lit("qty").alias("field"), F.lit("7").alias("value"), F.lit(1).alias("seq")
    ).where("action is not null")
    block = F.floor(F.col("sn") / sheets.ROW_BLOCK)
    return plan_items.apply_edits(rows.select("doc_id", "sn", "description", "qty", "unit", "rate", "amount"), edits, block)


# ------------------------------------------------------------------ comparison and registers
@query(
    "tier_comparison",
    V.sql_text(f"""WITH {V.BOQ_SQL}, t AS (SELECT b.doc_id, b.sn, b.description, x.tier, b.p_brand || '-' || x.tier AS brand,
   CAST(round(CAST(b.p_retailprice AS DECIMAL(18,4)) * CAST(x.f AS DECIMAL(6,2)), 2) AS DOUBLE) AS rate FROM boq b
   CROSS JOIN (VALUES ('budgetary', '0.80'), ('mid', '1.00'), ('high', '1.35')) x(tier, f)
   WHERE NOT (x.tier = 'budgetary' AND b.doc_id % 5 = 0) AND NOT (x.tier = 'high' AND b.sn % 4 = 0))
SELECT doc_id, sn, description, max(brand) FILTER (tier = 'budgetary') AS budgetary_brand, max(brand) FILTER (tier = 'mid') AS mid_brand, max(brand) FILTER (tier = 'high') AS high_brand,
  coalesce(max(rate) FILTER (tier = 'budgetary'), -1) AS budgetary_rate, coalesce(max(rate) FILTER (tier = 'mid'), -1) AS mid_rate, coalesce(max(rate) FILTER (tier = 'high'), -1) AS high_rate
FROM t GROUP BY doc_id, sn, description"""),
)
def tier_comparison(spark, sf):
    rows = V.numbered_boq(spark, sf, ("p_brand", "p_brand"), ("price", "CAST(p_retailprice AS DECIMAL(18,4))"))
    tiers = plan_items.replicate_tiers(rows).where("not (tier = 'budgetary' and doc_id % 5 = 0) and not (tier = 'high' and sn % 4 = 0)")
    share = F.when(F.col("tier") == "budgetary", F.lit("0.80")).when(F.col("tier") == "mid", F.lit("1.00")).otherwise(F.lit("1.35"))
    priced = tiers.withColumn("brand", F.concat_ws("-", "p_brand", "tier")).withColumn("rate", money(F.col("price") * share.cast("decimal(6,2)")))
    wide = costing.compare_tiers(priced, ("brand", "rate"))
    return wide.select(
        "doc_id", "sn", "description", *[f"{t}_brand" for t in rules.TIERS],
        *[F.coalesce(F.col(f"{t}_rate").cast("double"), F.lit(-1.0)).alias(f"{t}_rate") for t in rules.TIERS],
    )


REGISTER_COND = {
    "description": ["regexp_matches(title, '(?i)description|desc|disc|item|product')"],
    "brand": ["regexp_matches(title, '(?i)brand|maker|origin')"],
    "qty": ["regexp_matches(title, '(?i)revised.*qty|revised.*quantity|actual.*qty|actual.*quantity')", "regexp_matches(title, '(?i)qty|quantity|qt')"],
    "unit": ["regexp_matches(title, '(?i)uom|unit')"],
    "sn": ["regexp_matches(title, '(?i)s\\.?n|no\\.|#|sr|item|sl')"],
    "code": ["regexp_matches(title, '(?i)code|item.*code|ref')"],
}


@query(
    "delivery_register",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql({k: REGISTER_COND[k] for k in ('description', 'brand', 'unit')} | {'qty': REGISTER_COND['qty'][1:]})},
{V.role_values_sql(['description', 'qty', 'unit', 'brand'])}
SELECT v.doc_id, CAST(row_number() OVER (PARTITION BY v.doc_id ORDER BY row_idx) AS INTEGER) AS item_no, description,
  CASE WHEN r.brand_col IS NULL THEN '—' ELSE brand END AS brand, CASE WHEN r.unit_col IS NULL THEN 'No.' ELSE unit END AS unit, CAST({V.number_sql('qty')} AS DOUBLE) AS delivered_qty
FROM vals v JOIN roles r ON r.doc_id = v.doc_id WHERE {V.number_sql('qty')} > 0""",
)
def delivery_register(spark, sf):
    return _from_sheets(spark, sf, lambda header, table, whole: registers.delivery_register(sheets.with_roles(table, header, rules.DELIVERY_ROLES), whole=whole))


@query(
    "inspection_register",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql(REGISTER_COND)}, {V.role_values_sql(['description', 'qty', 'unit', 'brand', 'sn', 'code'])}
SELECT doc_id, row_idx AS item_no, CASE WHEN trim(code) <> '' THEN trim(code) WHEN trim(sn) <> '' THEN trim(sn) ELSE lpad(CAST(row_idx AS VARCHAR), 3, '0') END AS title,
  'MIR-7-' || lpad(CAST(row_idx AS VARCHAR), 3, '0') AS reference, description, qty, unit FROM vals""",
)
def inspection_register(spark, sf):
    found = _from_sheets(spark, sf, lambda header, table, whole: registers.inspection_register(sheets.with_roles(table, header, rules.REGISTER_ROLES), None, "MIR-7", whole))
    return found.select("doc_id", "item_no", "title", "reference", "description", "qty", "unit")


@query(
    "approval_register",
    f"""WITH {V.STITCH_SQL}, {V.roles_sql({'description': V.ROLE_COND['description'], 'qty': ["regexp_matches(title, '(?i)qty|quantity')"]})}, {V.role_values_sql(['description', 'qty'])}
SELECT doc_id, lpad(CAST(row_idx AS VARCHAR), 3, '0') AS item, description, qty FROM vals""",
)
def approval_register(spark, sf):
    found = _from_sheets(spark, sf, lambda header, table, whole: registers.approval_register(sheets.with_roles(table, header, rules.APPROVAL_ROLES), whole=whole))
    return found.select("doc_id", "item", "description", "qty")


@query(
    "line_counts",
    V.sql_text(f"""WITH {V.BOQ_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS all_rows, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS item_rows,
  CAST(count(*) FILTER (p_partkey % 4 = 0) AS BIGINT) AS offered_rows FROM boq GROUP BY doc_id"""),
)
def line_counts(spark, sf):
    rows = V.boq(
        spark, sf, ("is_header", "l_linestatus <> 'F'"), ("brand_image", "''"), ("brand_desc", "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END")
    )
    return registers.line_counts(rows)


@query(
    "number_parse",
    V.sql_text(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_partkey % 6 WHEN 0 THEN '1,' || lpad(CAST(l_suppkey AS VARCHAR), 3, '0') || '.50'
   WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' Nos' WHEN 2 THEN 'abc' WHEN 3 THEN ' .5' WHEN 4 THEN '-' || CAST(l_partkey AS VARCHAR) || '.' ELSE '' END AS x FROM lineitem)
SELECT x, CAST(coalesce({V.number_sql('x')}, -999999) AS DOUBLE) AS parsed,
  CAST(CASE WHEN x = '' THEN 1 WHEN regexp_matches(x, '[0-9]') THEN coalesce(TRY_CAST(trim(x) AS DECIMAL(18,4)), {V.number_sql("regexp_extract(x, '[0-9.]+')")}, 1) ELSE 1 END AS DOUBLE) AS qty,
  CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL"""),
)
def number_parse(spark, sf):
    text = """CASE l_partkey % 6 WHEN 0 THEN '1,' || lpad(CAST(l_suppkey AS STRING), 3, '0') || '.50' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' Nos'
      WHEN 2 THEN 'abc' WHEN 3 THEN ' .5' WHEN 4 THEN '-' || CAST(l_partkey AS STRING) || '.' ELSE '' END"""
    texts = V.table(spark, sf, "lineitem").select(F.expr(text).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return texts.select(
        "x", F.coalesce(parse_number("x"), F.lit(-999999)).alias("parsed"), clean_quantity("x").alias("qty"), "n"
    )
