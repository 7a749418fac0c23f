"""From raw sheet cells to one table per document.

``cells``: doc_id, sheet_id, sheet_order, row_no, col_no, value, or pieces of rows with ``entries``, a list of
(col_no, value), in place of the last two. One shuffle gathers each sheet row into a map from column number to text (a row
is as wide as the sheet, never more); header detection, filtering and typing are then row-level expressions. Cells that
lie together by document are gathered where they are.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import blank, nonzero_text, parse_loose_number
from billwright.functions.text import count_words
from billwright.operators.ordering import number_rows, running_sum

SHEET = ["doc_id", "sheet_id", "sheet_order"]
ROW_BLOCK = 65536


def cell_text(value, rich_text=None, link_text=None, formula_result=None, was_numeric=None):
    """Text of a cell: joined rich text, link text, formula result or the value; 0 reads as blank."""
    parts = []
    if rich_text is not None:
        parts.append(F.when(F.size(rich_text) > 0, F.array_join(rich_text, "")))
    if link_text is not None:
        parts.append(F.nullif(F.col(link_text), F.lit("")))
    if formula_result is not None:
        parts.append(F.col(formula_result))
    plain = F.col(value)
    if was_numeric is not None:
        zero = F.col(was_numeric) & (F.col(value).try_cast("double") == 0)
        plain = F.when(zero, F.lit("")).otherwise(plain)
    return F.trim(F.coalesce(*parts, plain, F.lit("")))


def attach_images(cell_images):
    """Images of one cell as an ordered list, one map per sheet row."""
    per_cell = cell_images.groupBy("doc_id", "sheet_id", "row_no", "col_no").agg(
        F.array_sort(F.collect_list(F.struct("ord", "url", "extension"))).alias("list")
    )
    listed = per_cell.withColumn(
        "list", F.transform("list", lambda i: F.struct(i["url"].alias("url"), i["extension"].alias("extension")))
    )
    return listed.groupBy("doc_id", "sheet_id", "row_no").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_no", "list")))).alias("images")
    )


def sheet_rows(cells, cell_images=None):
    """One record per sheet row: its cells, the header patterns it hits, whether it is a total."""
    if "entries" not in cells.columns:
        cells = cells.select(*SHEET, "row_no", F.array(F.struct("col_no", "value")).alias("entries"))
    texts = F.transform(F.flatten(F.collect_list("entries")), lambda e: F.struct(e["col_no"].alias("col_no"), F.coalesce(e["value"], F.lit("")).alias("value")))
    gathered = cells.groupBy(*SHEET, "row_no").agg(F.array_sort(texts).alias("_all")).where(F.size("_all") > 0)
    # Of several cells at one address the greatest text stays.
    last = F.filter("_all", lambda x, i: F.coalesce(F.get("_all", i + 1)["col_no"] != x["col_no"], F.lit(True)))
    gathered = gathered.withColumn("cells", F.map_from_entries(last)).drop("_all")
    # The patterns have no anchors, so one search over the joined texts finds a hit in any cell.
    text = gathered.withColumn("_text", F.array_join(F.map_values("cells"), "\u0001"))
    hits = F.lit(0)
    for pattern in rules.HEADER_PATTERNS:
        hits = hits + F.col("_text").rlike(pattern).cast("int")
    total = F.exists(F.map_values("cells"), lambda v: v.rlike(rules.SUMMARY_CELL))
    rows = (
        text.withColumn("width", F.array_max(F.map_keys("cells")))
        .withColumn("hits", hits)
        .drop("_text")
        .withColumn("is_total", F.when(F.col("hits") > 0, total).otherwise(F.lit(False)))
        .withColumn("text_col", F.array_min(F.map_keys(F.map_filter("cells", lambda k, v: v != ""))))
    )
    if cell_images is None:
        rows = rows.withColumn("images", F.lit(None).cast("map<int,array<struct<url:string,extension:string>>>"))
    else:
        rows = rows.join(attach_images(cell_images), ["doc_id", "sheet_id", "row_no"], "left")
    return rows.withColumn("image_col", F.array_min(F.map_keys("images")))


def header_rows(rows):
    """First row of each sheet that hits at least two header patterns (B1)."""
    return (
        rows.where("hits >= 2")
        .groupBy(*SHEET)
        .agg(
            F.min("row_no").alias("header_row"),
            F.min_by("cells", "row_no").alias("header"),
            F.min_by("width", "row_no").alias("header_width"),
        )
    )


def data_rows(rows, headers, drop_repeated=True):
    """Rows below the header, cut to its width, without repeated headers and blank rows.

    Which rows stay follows from their marks (first column with a text, with an image), so a pass that needs no cells reads none.
    """
    return _below_header(rows.join(headers.select(*SHEET, "header_row", "header_width"), SHEET), drop_repeated)


def _below_header(body, drop_repeated):
    in_width = lambda k: k <= F.col("header_width")
    body = body.where("row_no > header_row")
    if drop_repeated:
        body = body.where((F.col("hits") < 3) | F.col("is_total"))
    filled = F.coalesce(F.col("text_col") <= F.col("header_width"), F.lit(False)) | F.coalesce(F.col("image_col") <= F.col("header_width"), F.lit(False))
    return (
        body.where(filled)
        .withColumn("cells", F.map_filter("cells", lambda k, v: in_width(k)))
        .withColumn("images", F.map_filter("images", lambda k, v: in_width(k)))
        .drop("header_row", "hits", "is_total", "width", "text_col", "image_col")
    )


def document_header(headers, body):
    """Header of the first sheet with data, and the size of each document."""
    filled = body.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("sheet_rows"))
    return (
        headers.join(filled, SHEET)
        .groupBy("doc_id")
        .agg(
            F.min_by("header", "sheet_order").alias("header"),
            F.min_by("header_width", "sheet_order").alias("column_count"),
            F.count(F.lit(1)).alias("sheets"),
            F.sum("sheet_rows").alias("row_count"),
        )
    )


def stitch(rows, headers, drop_repeated=True, keep_images=True):
    """One table per document: header of its first sheet with data, rows of all sheets.

    Returns (header, table). ``table`` numbers the rows 1, 2, … over (sheet order, row). The numbering reads the marks of the rows
    only; ``rows`` should therefore be a written table.
    """
    body = data_rows(rows, headers, drop_repeated)
    if not keep_images:
        body = body.withColumn("images", F.lit(None).cast(body.schema["images"].dataType))
    block = F.struct("sheet_order", "sheet_id", F.floor(F.col("row_no") / ROW_BLOCK).alias("b"))
    table = number_rows(body, ["doc_id"], ["sheet_order", "sheet_id", "row_no"], "row_idx", block)
    return document_header(headers, body), table.drop("header_width")


def stitch_whole(rows, drop_repeated=True, keep_images=True):
    """``stitch`` for documents that each fit a task: windows over a document give header, numbers and sizes.

    Nothing is written, and rows that lie together by document are not exchanged.
    """
    sheet = Window.partitionBy("doc_id", "sheet_order", "sheet_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(F.when(F.col("hits") >= 2, F.col(c)), ignorenulls=True).over(sheet)
    headed = rows.withColumns({"header_row": first("row_no"), "header_width": first("width"), "header": first("cells")})
    body = _below_header(headed, drop_repeated)
    if not keep_images:
        body = body.withColumn("images", F.lit(None).cast(body.schema["images"].dataType))
    table = number_rows(body, ["doc_id"], ["sheet_order", "sheet_id", "row_no"], "row_idx", None)
    every = _document().rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = table.withColumns({"sheets": F.size(F.collect_set("sheet_id").over(every)).cast("bigint"), "row_count": F.count(F.lit(1)).over(every)})
    header = sized.where("row_idx = 1").select("doc_id", "header", F.col("header_width").alias("column_count"), "sheets", "row_count")
    return header, table.withColumn("header", F.when(F.col("row_idx") == 1, F.col("header"))).drop("header_width")


def _document():
    return Window.partitionBy("doc_id").orderBy("sheet_order")


def with_roles(table, header, role_table, default_description=None, money=False):
    """The table with the role columns of its document, and its money columns if wanted.

    A table of ``stitch_whole`` has the header beside its first row, from which all rows of the document take them; others are joined.
    """
    if "header" not in table.columns:
        joined = table.join(column_roles(header, role_table, default_description), "doc_id")
        return joined.join(money_columns(header), "doc_id", "left") if money else joined
    found = F.struct(*role_columns(role_table, default_description), *([money_column().alias("money_cols")] if money else []))
    spread = F.first(F.when(F.col("header").isNotNull(), found), ignorenulls=True).over(_document().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table.withColumn("_found", spread).select(*[c for c in table.columns if c != "header"], "_found.*")


def role_columns(role_table=rules.OFFER_ROLES, default_description=None):
    """First matching column of each role in ``header``; patterns of a role are tried in order."""
    columns = []
    for role, patterns in role_table.items():
        tries = [F.array_min(F.map_keys(F.map_filter("header", lambda k, v: v.rlike(p)))) for p in patterns]
        if role == "description" and default_description is not None:
            tries.append(F.lit(default_description))
        columns.append(F.coalesce(*tries).cast("int").alias(f"{role}_col"))
    return columns


def column_roles(header, role_table=rules.OFFER_ROLES, default_description=None):
    """Columns of each document's roles."""
    return header.where(F.size("header") > 0).select("doc_id", *role_columns(role_table, default_description))


def money_column():
    return F.array_sort(F.map_keys(F.map_filter("header", lambda k, v: v.rlike(rules.MONEY_COLUMN))))


def money_columns(header):
    """Columns that hold money (A3)."""
    return header.select("doc_id", money_column().alias("money_cols"))


def role_value(role):
    """Text in the column of a role, '' when the role or the cell is missing."""
    return F.coalesce(F.try_element_at("cells", F.col(f"{role}_col")), F.lit(""))


def row_image(images="images"):
    """Main image of the first cell that has one; relative addresses get a leading slash."""
    images = F.col(images)
    first_col = F.array_min(F.map_keys(images))
    url = F.try_element_at(F.try_element_at(images, first_col), F.lit(1))["url"]
    return F.when(url.startswith("http") | url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))


def boq_rows(table, roles=None, trim=False, drop_special=False):
    """Typed line items: sn, description, qty, unit, rate, amount, image (B7). Without ``roles`` the table carries them.

    ``trim`` and ``drop_special`` give the value-engineering variant.
    """
    def get(role):
        return F.trim(role_value(role)) if trim else role_value(role)

    joined = table if roles is None else table.join(roles, "doc_id")
    if drop_special:
        for flag in ("is_header", "is_summary"):
            if flag in table.columns:
                joined = joined.where(~F.coalesce(F.col(flag), F.lit(False)))
    return joined.select(
        "doc_id",
        "row_idx",
        F.col("row_idx").alias("sn"),
        row_image().alias("image_ref"),
        *[get(role).alias(role) for role in ("description", "qty", "unit", "rate", "amount")],
    )


def is_section(description, qty, unit, rate=None, words=rules.SECTION_WORDS):
    """True for headings: blank text, or a heading word without quantity and unit."""
    text = F.lower(F.trim(F.coalesce(F.col(description), F.lit(""))))
    data = [c for c in (qty, unit, rate) if c is not None]
    has_data = ~blank(F.trim(F.concat_ws("", *[F.col(c).cast("string") for c in data])))
    starts = F.lit(False)
    for word in words:
        starts = starts | (text == word) | text.startswith(word + " ")
    return (
        F.when(text == "", F.lit(True))
        .when(text.rlike(r"^\[.*?\]"), F.lit(False))
        .when(has_data, F.lit(False))
        .otherwise(starts | text.rlike(rules.SECTION_EXACT) | text.rlike(rules.SECTION_LIST_OF))
    )


def is_fitout(scope):
    return F.upper(F.coalesce(F.col(scope), F.lit(""))).contains("FITOUT")


def work_rows(rows, kind="furniture"):
    """Rows still to be matched (M16): no headings, right scope, not matched yet."""
    open_rows = rows.where(~is_section("description", "qty", "unit", "rate"))
    if kind == "fitout":
        return open_rows.where(is_fitout("scope") & blank("selected_brand"))
    if kind == "value_engineering":
        return rows.where(
            ~is_section("description", "qty", "unit", words=rules.SECTION_WORDS_SHORT)
            & (F.coalesce(F.col("ai_status"), F.lit("")) != "success")
        )
    return open_rows.where(~is_fitout("scope") & (F.coalesce(F.col("ai_status"), F.lit("")) != "success"))


def positional_products(cells):
    """Catalog rows from a sheet with fixed columns; the first row is skipped."""
    names = ["main_category", "sub_category", "family", "model", "description", "image_url", "price", "product_url"]
    rows = (
        cells.where("row_no > 1")
        .groupBy("doc_id", "sheet_id", "row_no")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.max(F.when(F.col("col_no") == i + 1, F.col("value"))).alias(n) for i, n in enumerate(names)],
        )
        .drop("_n")
    )
    for name in names:
        text = F.trim(F.coalesce(F.col(name), F.lit("")))
        rows = rows.withColumn(name, parse_loose_number(text) if name == "price" else text)
    return rows


def drop_extracted_headers(rows, shorter_than=rules.HEADER_TEXT_LENGTH):
    """Descriptions with two or more header words are headers if they are shorter than this."""
    text = F.lower(F.coalesce(F.col("description"), F.lit("")))
    hits = count_words(text, rules.EXTRACTED_HEADER_WORDS)
    return rows.where(~((hits >= 2) & (F.length(text) < shorter_than)))


def fill_serial_numbers(rows, block=None):
    """Keep usable serial numbers, count up for the missing ones in page order."""
    sn = F.trim(F.coalesce(F.col("sn").cast("string"), F.lit("")))
    marked = rows.withColumn("_ok", (sn != "") & ~sn.contains("undefined")).withColumn("_sn", sn)
    counted = running_sum(
        marked,
        ["doc_id"],
        ["page_num", "row_idx"],
        (~F.col("_ok")).cast("int"),
        "_missing",
        F.struct("page_num", F.floor(F.col("row_idx") / ROW_BLOCK).alias("b")) if block is None else block,
    )
    return counted.withColumn(
        "sn", F.when(F.col("_ok"), F.col("_sn")).otherwise(F.col("_missing").cast("string"))
    ).drop("_ok", "_sn", "_missing")


def shape_seven_columns(rows):
    """Fixed table: S.N, Image, Description, Qty, Unit, Rate, Amount."""
    return rows.select(
        "doc_id",
        "page_num",
        "row_idx",
        F.coalesce(F.col("sn").cast("string"), F.lit("")).alias("sn"),
        *([F.col("image")] if "image" in rows.columns else [F.lit(None).cast("string").alias("image")]),
        F.coalesce("description", F.lit("")).alias("description"),
        nonzero_text("qty").alias("qty"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        nonzero_text("rate").alias("rate"),
        nonzero_text("amount").alias("amount"),
    )
