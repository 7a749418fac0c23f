"""Driver tables seen as bills of quantities, catalogs, sheets, pages and events.

Each view exists twice: as a DataFrame for the operators and as SQL for the oracle. Both work over
the whole table.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright import rules
from billwright.operators.ordering import large_keys, number_rows

# ------------------------------------------------------------------ shared expressions (both engines)
FURNISH = """(CASE split_part(p_name, ' ', 1)
  WHEN 'blue' THEN 'ergonomic' WHEN 'cold' THEN 'executive' WHEN 'hot' THEN 'leather'
  WHEN 'large' THEN 'height adjustable' WHEN 'new' THEN 'staff' WHEN 'old' THEN 'high-back'
  WHEN 'red' THEN 'stackable' WHEN 'small' THEN 'lobby' ELSE split_part(p_name, ' ', 1) END
 || ' ' || CASE split_part(p_name, ' ', 2)
  WHEN 'anvil' THEN 'carpet tile' WHEN 'bolt' THEN 'chair' WHEN 'gear' THEN 'workstation'
  WHEN 'gizmo' THEN 'acoustic pod' WHEN 'plate' THEN 'glass partition' WHEN 'ring' THEN 'meeting table'
  WHEN 'rod' THEN 'pedestal' WHEN 'widget' THEN 'sofa' ELSE split_part(p_name, ' ', 2) END)"""
UNIT = """CASE p_type WHEN 'SMALL' THEN 'Nos' WHEN 'ECONOMY' THEN 'm2' WHEN 'MEDIUM' THEN 'LS'
  WHEN 'STANDARD' THEN 'set' WHEN 'PROMO' THEN 'unit' ELSE '' END"""
BRAND_NO = "CAST(substring(p_brand, 7) AS INT)"
TIER = f"CASE {BRAND_NO} % 3 WHEN 0 THEN 'budgetary' WHEN 1 THEN 'mid' ELSE 'high' END"
MODEL = f"""CASE WHEN p_partkey % 97 = 5 THEN ''
  WHEN p_partkey % 3 = 0 THEN {FURNISH} || ' #' || CAST(p_partkey AS STRING)
  WHEN p_partkey % 5 = 0 THEN {FURNISH} || ' ' || CAST(p_size AS STRING)
  ELSE {FURNISH} END"""
SIZE_TEXT = "CAST(p_size * 40 AS STRING) || CASE WHEN p_size % 2 = 0 THEN 'x' ELSE ' X ' END || CAST(20 + p_size AS STRING)"
DESCRIPTION = f"{FURNISH} || ' ' || {SIZE_TEXT}"
IMAGE_URL = "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://img.example.com/' || CAST(p_partkey % 500 AS STRING) || '.jpg' END"
PRODUCT_URL = "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'https://shop.example.com/p/item-' || CAST(p_partkey % 900 AS STRING) END"
NORM_CATEGORY = "CASE WHEN p_partkey % 5 = 1 THEN 'null' WHEN p_partkey % 5 = 2 THEN p_type || ' N' ELSE '' END"
IDENTIFIED = f"""CASE WHEN p_partkey % 11 = 3 THEN split_part({FURNISH}, ' ', 1) || ' ' || split_part({FURNISH}, ' ', 1) || ' big tall wide' ELSE CASE p_partkey % 7
  WHEN 0 THEN upper({FURNISH}) || ' #99'
  WHEN 1 THEN replace(replace(replace({FURNISH}, 'chair', 'stool'), 'meeting table', 'desk'), 'sofa', 'couch')
  WHEN 2 THEN split_part({FURNISH}, ' ', 1)
  WHEN 3 THEN {FURNISH} || ' deluxe edition'
  WHEN 4 THEN split_part({FURNISH}, ' ', 2) || ' ' || split_part({FURNISH}, ' ', 1) || ' desk sofa'
  WHEN 5 THEN 'c' || CAST(p_size % 10 AS STRING)
  ELSE 'desk table ' || split_part({FURNISH}, ' ', 1) END END"""
WANTED_CATEGORY = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_type WHEN 2 THEN 'PROMO' ELSE 'ab' END"

FACTORS = dict(profit=10, freight=5, customs=3, installation="2.5", vat=5, exchange_rate="0.385")


def sql_text(expr):
    """The same expression for DuckDB."""
    return expr.replace("AS STRING", "AS VARCHAR").replace("AS INT)", "AS INTEGER)")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark, sf):
    """Parts with their furniture text as a column of its own, so later expressions stay short."""
    return table(spark, sf, "part").withColumn("fname", F.expr(FURNISH))


def dealt_parts(spark, sf):
    """Parts dealt to as many tasks as a shuffle has. A million of them lie in one or two row groups, and what is made of them would be parsed in as few tasks."""
    return parts(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def on_parts(expr):
    """Shared expression over ``parts``."""
    return F.expr(expr.replace(FURNISH, "fname"))


# ------------------------------------------------------------------ bills of quantities
#: Lines of a document that one task takes at once.
LARGE_DOCUMENT = 65536
_RATE_E4 = "(CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT)) {div} (2 * CAST(l_quantity AS BIGINT))"


def boq(spark, sf, *extra, lines=None):
    """Line items: doc_id, sn, description, qty, unit, rate, amount and a few attributes."""
    lines = table(spark, sf, "lineitem") if lines is None else lines
    parts = table(spark, sf, "part")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.expr(FURNISH).alias("description"),
        F.col("l_quantity").cast("decimal(18,4)").alias("qty"),
        F.expr(UNIT).alias("unit"),
        F.expr(f"CAST(CAST({_RATE_E4.format(div='div')} AS DECIMAL(18,0)) * CAST('0.0001' AS DECIMAL(5,4)) AS DECIMAL(18,4))").alias("rate"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'Fitout' ELSE 'Furniture' END").alias("scope"),
        F.expr("'Room ' || CAST(l_suppkey % 12 AS STRING)").alias("location"),
        *[F.expr(e).alias(n) for n, e in extra],
    )
    return joined


def numbered_boq(spark, sf, *extra, lines=None, whole=False):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    block = None if whole else F.floor(F.col("l_linenumber") / 65536)
    return number_rows(boq(spark, sf, *extra, lines=lines), ["doc_id"], order, "sn", block)


def by_document_size(spark, sf, build):
    """``build(lines, whole)`` over the lines of documents that fit a task, and apart from them over those of larger ones, if any."""
    lines = table(spark, sf, "lineitem")
    large = large_keys(lines, ["l_orderkey"], LARGE_DOCUMENT)
    if large.isEmpty():
        return build(lines, True)
    is_large = F.col("l_orderkey").eqNullSafe(F.col("_large"))
    names = large.select(F.col("l_orderkey").alias("_large"))
    return build(lines.join(names, is_large, "left_anti"), True).unionByName(build(lines.join(names, is_large, "left_semi"), False))


BOQ_SQL = sql_text(f"""boq AS (
  SELECT l_orderkey AS doc_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS sn,
    l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
    {FURNISH} AS description, CAST(l_quantity AS DECIMAL(18,4)) AS qty, {UNIT} AS unit,
    CAST(CAST({_RATE_E4.format(div='//')} AS DECIMAL(18,0)) * CAST('0.0001' AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS rate,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'Fitout' ELSE 'Furniture' END AS scope,
    'Room ' || CAST(l_suppkey % 12 AS STRING) AS location
  FROM lineitem JOIN part ON l_partkey = p_partkey)""")


# ------------------------------------------------------------------ catalog
def catalog(spark, sf):
    return parts(spark, sf).select(
        F.col("p_brand").alias("brand_id"),
        F.col("p_brand").alias("brand"),
        F.expr(TIER).alias("tier"),
        F.col("p_partkey").alias("pos"),
        F.col("p_type").alias("main_category"),
        F.expr("p_type || ' S' || CAST(p_size % 5 AS STRING)").alias("sub_category"),
        F.expr("'F' || CAST(p_size % 3 AS STRING)").alias("family"),
        on_parts(MODEL).alias("model"),
        on_parts(DESCRIPTION).alias("description"),
        F.expr(IMAGE_URL).alias("image_url"),
        F.expr(PRODUCT_URL).alias("product_url"),
        F.expr(NORM_CATEGORY).alias("norm_category"),
        F.lit("").alias("norm_sub_category"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("price"),
    )


CATALOG_SQL = sql_text(f"""catalog AS (
  SELECT p_brand AS brand_id, p_brand AS brand, {TIER} AS tier, p_partkey AS pos, p_type AS main_category,
    p_type || ' S' || CAST(p_size % 5 AS STRING) AS sub_category, 'F' || CAST(p_size % 3 AS STRING) AS family,
    {MODEL} AS model, {DESCRIPTION} AS description, {IMAGE_URL} AS image_url, {PRODUCT_URL} AS product_url,
    {NORM_CATEGORY} AS norm_category, '' AS norm_sub_category, CAST(p_retailprice AS DECIMAL(18,4)) AS price, p_name, p_size, p_partkey, p_type
  FROM part)""")


def brands(spark, sf):
    """One row per brand document, ordered by its number."""
    return (
        table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("p_brand").alias("brand_id"),
            F.col("p_brand").alias("name"),
            F.expr(TIER).alias("tier"),
            F.expr(BRAND_NO).alias("brand_order"),
            F.expr("'https://img.example.com/logo-' || p_brand || '.png'").alias("logo"),
        )
    )


BRANDS_SQL = sql_text(f"""brands AS (
  SELECT DISTINCT p_brand AS brand_id, p_brand AS name, {TIER} AS tier, {BRAND_NO} AS brand_order,
    'https://img.example.com/logo-' || p_brand || '.png' AS logo FROM part)""")


def identified(spark, sf):
    """Models named by an identification step, to be found in the catalog."""
    return parts(spark, sf).select(
        F.col("p_partkey").alias("target_id"),
        F.col("p_brand").alias("brand_id"),
        on_parts(IDENTIFIED).alias("model"),
        F.expr(WANTED_CATEGORY).alias("category"),
    )


IDENTIFIED_SQL = sql_text(f"""identified AS (
  SELECT p_partkey AS target_id, p_brand AS brand_id, {IDENTIFIED} AS model, {WANTED_CATEGORY} AS category FROM part)""")

# Model key in SQL.
def key_sql(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '#[0-9]+', '', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


# ------------------------------------------------------------------ sheets
HEADERS = [
    ["S.N", "Image", "Description", "Qty", "Unit", "Rate", "Amount"],
    ["Item No.", "Photo", "Item Desc", "Unit Price", "Quantity", "UOM", "Total Amount"],
    ["Sr", "Ref", "Product", "Total Qty", "Unit", "Price", "Total"],
]
# Text of the data columns per header variant.
COLUMNS = [
    ["sn_text", "''", "description", "qty_text", "unit", "rate_text", "amount_text"],
    ["sn_text", "''", "description", "rate_text", "qty_text", "unit", "amount_text"],
    ["sn_text", "code", "description", "qty_text", "unit", "rate_text", "amount_text"],
]


def _pick(options):
    return "CASE doc_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END".format(*options)


def _columns():
    return [_pick([COLUMNS[v][c] for v in range(3)]) for c in range(7)] + ["CASE WHEN sn % 5 = 0 THEN 'side note' END"]


def _header(c):
    return _pick([f"'{HEADERS[v][c]}'" for v in range(3)])


_SHEET = "CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END"
_TEXTS = [
    ("sn_text", "CAST(sn AS STRING)"),
    ("code", "'C-' || CAST(l_partkey % 50 AS STRING)"),
    ("qty_text", "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(qty AS STRING) END"),
    ("rate_text", "CAST(rate AS STRING)"),
    ("amount_text", "CASE WHEN l_partkey % 13 = 0 THEN 'incl.' ELSE CAST(amount AS STRING) END"),
]


def _piece(row, entries):
    listed = ", ".join(f"struct({col} AS col_no, {value} AS value)" for col, value in entries)
    return f"struct({row} AS row_no, filter(array({listed}), e -> e.value IS NOT NULL) AS entries)"


def _fixed_pieces():
    """Title, header, blank row, repeated header and total of a sheet."""
    total = "CAST(CAST(total AS DECIMAL(18,4)) AS STRING)"
    return [
        _piece(1, [(1, "'Schedule of works'")]),
        _piece(3, [(c + 1, _header(c)) for c in range(7)]),
        _piece(4, [(c, "''") for c in (1, 2, 3)]),
        _piece(5000000, [(c + 1, f"CASE WHEN doc_id % 4 = 0 THEN {_header(c)} END") for c in range(7)]),
        _piece(6000000, [
            (3, "CASE WHEN doc_id % 2 = 0 THEN 'TOTAL AMOUNT' END"),
            (5, "CASE WHEN doc_id % 8 = 0 THEN 'unit rate' END"),
            (7, f"CASE WHEN doc_id % 2 = 0 THEN {total} END"),
        ]),
    ]


def row_pieces(spark, sf, lines=None, whole=False):
    """Two sheets per document, row by row: title, header, blank row, items, repeated header, total."""
    rows = numbered_boq(spark, sf, lines=lines, whole=whole)
    for name, expr in _TEXTS:
        rows = rows.withColumn(name, F.expr(expr))
    rows = rows.withColumn("sheet_id", F.expr(_SHEET))
    item = _piece("10 + sn", [(i + 1, c) for i, c in enumerate(_columns())])
    fixed = ", ".join(_fixed_pieces())
    if whole:
        # The first line of a sheet brings what the sheet holds besides its lines.
        document = Window.partitionBy("doc_id")
        of_sheet = lambda f, c: F.coalesce(*[F.when(F.col("sheet_id") == s, f(F.when(F.col("sheet_id") == s, F.col(c))).over(document)) for s in (1, 2)])
        rows = rows.withColumns({"total": of_sheet(F.sum, "amount"), "_first": of_sheet(F.min, "sn")})
        pieces = rows.select("doc_id", "sheet_id", F.explode(F.expr(f"IF(sn = _first, array({item}, {fixed}), array({item}))")).alias("p"))
    else:
        sheets = boq(spark, sf, lines=lines).groupBy("doc_id", F.expr(_SHEET).alias("sheet_id")).agg(F.sum("amount").alias("total"))
        pieces = rows.select("doc_id", "sheet_id", F.expr(item).alias("p")).unionByName(sheets.select("doc_id", "sheet_id", F.explode(F.expr(f"array({fixed})")).alias("p")))
    return pieces.select("doc_id", "sheet_id", F.col("sheet_id").alias("sheet_order"), "p.row_no", "p.entries").where("size(entries) > 0")


def cells(spark, sf):
    """The cells of ``row_pieces``, one by one."""
    pieces = row_pieces(spark, sf)
    return pieces.select("doc_id", "sheet_id", "sheet_order", "row_no", F.explode("entries").alias("e")).select("doc_id", "sheet_id", "sheet_order", "row_no", "e.*")


def _cells_sql():
    texts = ", ".join(f"{e} AS {n}" for n, e in _TEXTS)
    body = " UNION ALL ".join(
        f"SELECT doc_id, sheet_id, 10 + sn AS row_no, {i + 1} AS col_no, {c} AS value FROM boq_text" for i, c in enumerate(_columns())
    )
    fixed = ["SELECT doc_id, sheet_id, 1 AS row_no, 1 AS col_no, 'Schedule of works' AS value FROM sheets"]
    for c in range(7):
        fixed.append(f"SELECT doc_id, sheet_id, 3, {c + 1}, {_header(c)} FROM sheets")
        fixed.append(f"SELECT doc_id, sheet_id, 5000000, {c + 1}, {_header(c)} FROM sheets WHERE doc_id % 4 = 0")
    for c in (1, 2, 3):
        fixed.append(f"SELECT doc_id, sheet_id, 4, {c}, '' FROM sheets")
    fixed.append("SELECT doc_id, sheet_id, 6000000, 3, 'TOTAL AMOUNT' FROM sheets WHERE doc_id % 2 = 0")
    fixed.append("SELECT doc_id, sheet_id, 6000000, 5, 'unit rate' FROM sheets WHERE doc_id % 8 = 0")
    fixed.append("SELECT doc_id, sheet_id, 6000000, 7, CAST(CAST(total AS DECIMAL(18,4)) AS STRING) FROM sheets WHERE doc_id % 2 = 0")
    return sql_text(
        f"""boq_text AS (SELECT *, {_SHEET} AS sheet_id, {texts} FROM boq),
sheets AS (SELECT doc_id, sheet_id, sum(amount) AS total FROM boq_text GROUP BY doc_id, sheet_id),
cells AS (SELECT * FROM ({body} UNION ALL {' UNION ALL '.join(fixed)}) WHERE value IS NOT NULL)"""
    )


CELLS_SQL = BOQ_SQL + ",\n" + _cells_sql()

# Patterns hit by a text, without lookahead.
HIT_SQL = [
    f"max(CASE WHEN regexp_matches(value, '{p}') THEN 1 ELSE 0 END)" for p in rules.HEADER_PATTERNS
]
SHEET_ROWS_SQL = f"""sheet_rows AS (
  SELECT doc_id, sheet_id, row_no, max(col_no) AS width, {' + '.join(HIT_SQL)} AS hits,
    max(CASE WHEN regexp_matches(value, '(?i)^total\\s*(amount)?$') THEN 1 ELSE 0 END) AS is_total
  FROM cells GROUP BY doc_id, sheet_id, row_no),
headers AS (
  SELECT r.* FROM sheet_rows r JOIN (
    SELECT doc_id, sheet_id, min(row_no) AS row_no FROM sheet_rows WHERE hits >= 2 GROUP BY doc_id, sheet_id) m
  USING (doc_id, sheet_id, row_no))"""


def body_sql(drop_repeated=True):
    rule = "AND (r.hits < 3 OR r.is_total = 1)" if drop_repeated else ""
    return f"""body AS (
  SELECT c.doc_id, c.sheet_id, c.row_no, c.col_no, c.value
  FROM cells c JOIN headers h ON c.doc_id = h.doc_id AND c.sheet_id = h.sheet_id AND c.col_no <= h.width
  JOIN sheet_rows r ON r.doc_id = c.doc_id AND r.sheet_id = c.sheet_id AND r.row_no = c.row_no
  WHERE c.row_no > h.row_no {rule}),
kept AS (SELECT doc_id, sheet_id, row_no FROM body GROUP BY ALL HAVING max(CASE WHEN value <> '' THEN 1 ELSE 0 END) = 1),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sheet_id, row_no) AS INTEGER) AS row_idx FROM kept),
first_sheet AS (SELECT doc_id, min(sheet_id) AS sheet_id FROM kept GROUP BY doc_id),
head AS (SELECT c.doc_id, c.col_no, c.value AS title FROM cells c JOIN first_sheet f USING (doc_id, sheet_id)
  JOIN headers h ON h.doc_id = c.doc_id AND h.sheet_id = c.sheet_id AND h.row_no = c.row_no)"""


STITCH_SQL = CELLS_SQL + ",\n" + SHEET_ROWS_SQL + ",\n" + body_sql()
# Column roles without lookahead: every pattern as a DuckDB condition on the title.
ROLE_COND = {
    "description": ["regexp_matches(title, '(?i)description|desc')"],
    "qty": ["regexp_matches(title, '(?i)qty|quantity') AND NOT regexp_matches(title, '(?i)rate|price|amount')",
            "regexp_matches(title, '(?i)qty|quantity')"],
    "unit": ["regexp_matches(title, '(?i)unit|uom')"],
    "rate": ["regexp_matches(title, '(?i)rate|price')"],
    "amount": ["regexp_matches(title, '(?i)total|amount') AND NOT regexp_matches(title, '(?i)qty|quantity')",
               "regexp_matches(title, '(?i)amount|total')"],
}
AMOUNT_OR_TOTAL = ("(regexp_matches(title, '(?i)amount') OR (regexp_matches(title, '(?i)total') AND "
                   "NOT regexp_matches(regexp_replace(lower(title), '^.*total', ''), 'qty|quantity')))")
VIEWER_COND = {
    "rate": ["regexp_matches(title, '(?i)rate|price')"],
    "amount": [AMOUNT_OR_TOTAL],
    "qty": ["regexp_matches(title, '(?i)qty|quantity|qt')"],
    "unit": ["regexp_matches(title, '(?i)unit|uom')"],
    "description": ["regexp_matches(title, '(?i)description|desc|disc|item|product')"],
    "image": ["regexp_matches(title, '(?i)image|photo|picture|img|pic|ref')"],
}


def roles_sql(conds, default_description=None, name="roles"):
    cols = []
    for role, tries in conds.items():
        parts = [f"min(CASE WHEN {t} THEN col_no END)" for t in tries]
        if role == "description" and default_description:
            parts.append(str(default_description))
        cols.append(f"CAST(coalesce({', '.join(parts)}, NULL) AS INTEGER) AS {role}_col")
    return f"{name} AS (SELECT doc_id, {', '.join(cols)} FROM head GROUP BY doc_id)"


def role_values_sql(roles, name="vals", roles_name="roles"):
    cols = ", ".join(f"coalesce(max(CASE WHEN b.col_no = r.{x}_col THEN b.value END), '') AS {x}" for x in roles)
    return f"""{name} AS (SELECT n.doc_id, n.row_idx, {cols} FROM numbered n
  JOIN body b USING (doc_id, sheet_id, row_no) JOIN {roles_name} r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.row_idx)"""


# Number prefix of a text (P0) as a nullable decimal.
def number_sql(x):
    return (f"TRY_CAST(regexp_extract(replace({x}, ',', ''), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DECIMAL(18,4))")


# ------------------------------------------------------------------ events
def activity(spark, sf):
    """Session activity: each event touches a file or a blob."""
    return activity_of(table(spark, sf, "events"))


def activity_of(events):
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.expr("CASE WHEN event_type IN ('view', 'click') THEN 'blob' ELSE 'file' END").alias("kind"),
        F.expr("'ref-' || CAST(event_id % 37 AS STRING)").alias("ref"),
    )


ACTIVITY_SQL = """activity AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'blob' ELSE 'file' END AS kind,
    'ref-' || CAST(event_id % 37 AS VARCHAR) AS ref FROM events)"""


# ------------------------------------------------------------------ pages
def lined_documents(spark, sf):
    """Text lines of the documents as page items: 50 lines to a page, 20 units apart."""
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "str"))
    return lines.select(
        "doc_id",
        F.floor(F.col("line_no") / 50).cast("int").alias("page"),
        (F.col("line_no") % 50).cast("int").alias("line_no"),
        "str",
    )


DOC_LINES_SQL = r"""doc_lines AS (
  SELECT doc_id, CAST((i - 1) // 50 AS INTEGER) AS page, CAST((i - 1) % 50 AS INTEGER) AS line_no, parts[i] AS str
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
  LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"""
