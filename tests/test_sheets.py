from pyspark.sql import functions as F

from billwright import rules
from billwright.operators import costing, registers, sheets
from billwright.plans.boq_costing import cost_documents, structure
from billwright.queries import boq, views  # noqa: F401
from billwright.queries.registry import QUERIES

SHEET1 = {
    1: ["Tender 7"],
    3: ["S.N", "Image", "Description", "Qty", "Unit", "Rate", "Amount"],
    4: ["1", "", "Chair", "2", "Nos", "1,000.50", "2,001.00", "beyond"],
    5: ["", "", "", "", "", "", "", "only beyond the header"],
    6: ["2", "", "[FL-01] Carpet", "12 Nos", "m2", "10", "120"],
    7: ["S.N", "Image", "Description", "Qty", "Unit", "Rate", "Amount"],
    8: ["", "", "TOTAL AMOUNT", "", "unit", "rate", "2,121.00"],
}
SHEET2 = {2: ["Item", "Unit Price", "Unit"], 3: ["9", "", "Second sheet row"]}
SHEET3 = {1: ["no header here"], 2: ["x"]}


def cells(spark):
    rows = []
    for order, sheet in enumerate((SHEET1, SHEET2, SHEET3), 1):
        for row, values in sheet.items():
            rows += [("d", order, order, row, col, v) for col, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "doc_id string, sheet_id int, sheet_order int, row_no int, col_no int, value string")


def test_structure(spark):
    pics = spark.createDataFrame(
        [("d", 1, 6, 2, 1, "b.png", "png"), ("d", 1, 6, 2, 0, "a.png", "png")],
        "doc_id string, sheet_id int, row_no int, col_no int, ord int, url string, extension string",
    )
    header, table = structure(cells(spark), pics)
    roles = sheets.column_roles(header, rules.OFFER_ROLES, default_description=2)
    rows = sheets.boq_rows(table, roles).orderBy("sn").collect()
    assert [r["description"] for r in rows] == ["Chair", "[FL-01] Carpet", "TOTAL AMOUNT", "Second sheet row"]
    assert rows[0]["qty"] == "2" and rows[0]["amount"] == "2,001.00"
    assert rows[1]["image_ref"] == "/a.png"
    legacy = structure(cells(spark), drop_repeated=False, keep_images=False)[1]
    assert legacy.count() == 5


def test_summary_and_totals(spark):
    out = cost_documents(cells(spark), costing.factors(profit=10, vat=5, exchange_rate="1"))
    s = out["summary"].first()
    assert (float(s["total_rate"]), float(s["total_amount"]), s["total_qty"], s["item_count"]) == (1010.50, 4242.0, 14, 3)
    t = out["totals"].first()
    assert float(t["subtotal"]) == 2201.10 + 132.00 + 2333.10
    assert abs(t["subtotal"] + t["vat_amount"] - t["grand_total"]) == 0


def test_roles_take_first_unit_column(spark):
    df = spark.createDataFrame([("d", {1: "Unit Price", 2: "Unit", 3: "Total Qty", 4: "Total"})], "doc_id string, header map<int,string>")
    r = sheets.column_roles(df, rules.OFFER_ROLES, 2).first()
    assert (r["unit_col"], r["rate_col"], r["qty_col"], r["amount_col"], r["description_col"]) == (1, 1, 3, 4, 2)
    v = sheets.column_roles(df, rules.VIEWER_ROLES).first()
    assert v["amount_col"] == 4


def test_sections(spark):
    rows = spark.createDataFrame(
        [("HEAD OF CHAIR", "", ""), ("LIST OF FURNITURE", "", ""), ("total amount", "", ""), ("total amount", "3", ""), ("[A] x", "", ""), ("", "1", "1")],
        "d string, q string, u string",
    )
    got = [r[0] for r in rows.select(sheets.is_section("d", "q", "u")).collect()]
    assert got == [False, True, True, False, False, True]


def test_cell_text(spark):
    df = spark.createDataFrame(
        [("0", True, None, None), ("0", False, None, None), ("x", False, ["a ", "b"], None), ("v", False, None, "link ")],
        "value string, num boolean, rich array<string>, link string",
    )
    got = [r[0] for r in df.select(sheets.cell_text("value", "rich", "link", was_numeric="num")).collect()]
    assert got == ["", "0", "a b", "link"]


def test_serial_fill(spark):
    rows = spark.createDataFrame(
        [("d", 1, 0, ""), ("d", 1, 1, "7"), ("d", 2, 0, "undefined"), ("d", 2, 1, None)], "doc_id string, page_num int, row_idx int, sn string"
    )
    got = sheets.fill_serial_numbers(rows).orderBy("page_num", "row_idx").collect()
    assert [r["sn"] for r in got] == ["1", "7", "2", "3"]


def test_two_cells_at_one_address(spark):
    cells = spark.createDataFrame(
        [("d", 1, 0, "s", 1, 1, "Item"), ("d", 1, 0, "s", 1, 1, "Description"), ("d", 1, 0, "s", 1, 2, None), ("d", 1, 0, "s", 1, 2, "Qty")],
        "doc_id string, sheet_id int, sheet_order int, sheet_name string, row_no int, col_no int, value string",
    )
    row = sheets.sheet_rows(cells).first()
    assert row["cells"] == {1: "Item", 2: "Qty"} and row["width"] == 2


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_whole_documents_are_structured_alike(spark):
    many = cells(spark).unionByName(cells(spark).withColumn("doc_id", F.lit("e"))).repartition(3, "doc_id")
    for how in ({}, {"drop_repeated": False, "keep_images": False}):
        plain, whole = structure(many, **how), structure(many, whole=True, **how)
        for columns, i in ((["doc_id", "header", "column_count", "sheets", "row_count"], 0), (["doc_id", "sheet_id", "row_no", "row_idx", "cells"], 1)):
            a, b = ([tuple(map(str, r)) for r in x[i].select(*columns).collect()] for x in (plain, whole))
            assert sorted(a) == sorted(b) and a
    header, table = structure(many, whole=True)
    joined = sheets.with_roles(structure(many)[1], header, rules.REGISTER_ROLES)
    spread = sheets.with_roles(table, header, rules.REGISTER_ROLES)
    both = [sorted(map(str, registers.inspection_register(t, None, "R", w).collect())) for t, w in ((joined, False), (spread, True))]
    assert both[0] == both[1] and len(both[0]) == 8


def test_rows_of_whole_documents_stay_where_they_are(spark):
    """Cells dealt by document are gathered, stitched and numbered without a further exchange."""
    header, table = structure(cells(spark).repartition("doc_id"), whole=True)
    found = registers.inspection_register(sheets.with_roles(table, header, rules.REGISTER_ROLES), None, "R", True)
    assert _exchanges(found) == 1


def test_large_documents_are_built_apart(spark, tmp_path, monkeypatch):
    lines = [(d, n, 1 + n % 2, 1, 10.0 * n, 2.0, "R", "F") for d in range(1, 9) for n in range(1, 3 + d)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "blue bolt", "Brand#1", "SMALL", 3, 9.0), (2, "cold ring", "Brand#2", "PROMO", 4, 8.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    names = ["header_detect", "table_costing", "inspection_register"]
    got = {}
    for most in (65536, 6):
        monkeypatch.setattr(views, "LARGE_DOCUMENT", most)
        got[most] = {n: sorted(map(str, QUERIES[n](spark, str(tmp_path)).collect())) for n in names}
    assert got[65536] == got[6] and all(got[6].values())
