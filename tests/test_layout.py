import random
import time

from pyspark.sql import functions as F

from billwright.operators import layout, plan_items


def test_text_lines_join_first_cluster(spark):
    rows = [("d", 0, i, t, x, y, 10, 10) for i, (t, x, y) in enumerate([("b", 50, 100), ("a", 10, 108), ("c", 10, 117), ("d", 10, 300), (" ", 10, 500)])]
    items = spark.createDataFrame(rows, "doc_id string, page int, ord int, str string, x int, y int, w int, h int")
    got = [(r["y"], r["text"]) for r in layout.text_lines(items).orderBy("y").collect()]
    # 117 is out of reach of the first item of line 100, so it starts a line of its own.
    assert got == [(100, "a b"), (117, "c"), (300, "d")]


def folded(items, reach=10):
    """Lines by the literal rule: every item in order joins the lowest line near enough, or starts one."""
    lines = {}
    for order, y, x, text in items:
        near = [line for line in lines if abs(line - y) <= reach]
        lines.setdefault(min(near) if near else y, []).append((x, order, text))
    return sorted((y, " ".join(t for *_, t in sorted(ws)).strip()) for y, ws in lines.items())


def test_text_lines_that_drift(spark):
    r = random.Random(5)
    pages = [[(i, i * r.randrange(1, 4) % 400, r.randrange(300), f"w{i}") for i in range(300)], [(i, r.randrange(120), i, f"w{i}") for i in range(200)], [(i, -i, 0, "x") for i in range(90)]]
    rows = [("d", p, i, t, x, float(y), 1, 1) for p, items in enumerate(pages) for i, y, x, t in items]
    items = spark.createDataFrame(rows, "doc_id string, page int, ord int, str string, x int, y double, w int, h int").repartition(7)
    got = layout.text_lines(items).collect()
    for p, page in enumerate(pages):
        assert sorted((l["y"], l["text"]) for l in got if l["page"] == p) == folded(page)


def test_long_page_of_lines(spark):
    """A page of 100,000 items: the fold runs over its distinct heights."""
    items = spark.range(100_000).selectExpr("'d' doc_id", "1 page", "id ord", "concat('w', id) str", "id x", "(id * 7919) % 900 y")
    lines = layout.text_lines(items).select("y", F.size("words").alias("n")).collect()
    assert sum(r["n"] for r in lines) == 100_000 and 40 <= len(lines) <= 82


def test_images_are_claimed_once(spark):
    images = spark.createDataFrame(
        [("d", 1, 0, 300, 100, 60, 40, "i0"), ("d", 1, 1, 300, 220, 60, 40, "i1")],
        "doc_id string, page int, ord int, x int, y int, w int, h int, path string",
    )
    items = spark.createDataFrame(
        [("d", 1, 0, "1", 60, 115, 10, 10), ("d", 1, 1, "2", 60, 130, 10, 10), ("d", 1, 2, "Lounge chairs", 60, 900, 10, 10)],
        "doc_id string, page int, ord int, str string, x int, y int, w int, h int",
    )
    rows = spark.createDataFrame(
        [("d", 1, 0, "1", "Chair"), ("d", 1, 1, "2", "Desk"), ("d", 1, 2, "", "Lounge chair")], "doc_id string, page int, row_idx int, sn string, description string"
    )
    got = {r["row_idx"]: r["path"] for r in layout.pair_images(rows, items, images).collect()}
    assert got == {0: "i0", 1: "i1"}
    two = rows.where("row_idx < 2")
    assert {r["row_idx"]: r["path"] for r in layout.pair_images(two, items, images).collect()} == {0: "i0", 1: "i1"}


def test_image_by_line(spark):
    rows = spark.createDataFrame([("d", 1, 0, "12", None), ("d", 1, 1, "x", 0), ("d", 1, 2, "y", None)], "doc_id string, page int, row_idx int, sn string, image_ref int")
    items = spark.createDataFrame([("d", 1, 0, "12.", 10, 500, 5, 5)], "doc_id string, page int, ord int, str string, x int, y int, w int, h int")
    images = spark.createDataFrame([("d", 1, 0, 100), ("d", 1, 1, 530), ("d", 1, 2, 900)], "doc_id string, page int, ord int, y int")
    got = {r["row_idx"]: r["image_ord"] for r in layout.image_by_line(rows, layout.text_lines(items), images).collect()}
    assert got == {0: 1, 1: 0, 2: 2}


def test_lines_travel_once_by_page(spark):
    """The items of a page are exchanged once and meet no other frame on the way to their lines."""
    items = spark.range(3000).selectExpr("id % 3 doc_id", "1 page", "id ord", "concat('w', id) str", "id % 90 x", "id % 400 y")
    lines = layout.text_lines(items)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    assert sorted(r["doc_id"] for r in lines.select("doc_id").distinct().collect()) == [0, 1, 2]


def test_anchor_of_a_very_long_text(spark):
    """A text of 400,000 letters is searched, not cut into pieces: cut, this took minutes."""
    long = "".join(random.Random(1).choices("abcdefghij", k=400_000))
    items = spark.createDataFrame([("d", 1, 0, "7.", 10, 20), ("d", 1, 1, long, 10, 40), ("d", 1, 2, "The last-one here", 10, 60)], "doc_id string, page int, ord int, str string, x int, y int")
    rows = spark.createDataFrame([("d", 1, 0, "7", None), ("d", 1, 1, "8", long[-20:]), ("d", 1, 2, None, "last one"), ("d", 1, 3, "9", "nowhere"), ("d", 2, 0, "7", "x")], "doc_id string, page int, row_idx int, sn string, description string")
    start = time.time()
    got = {(r["page"], r["row_idx"]): (r["sn_y"], r["anchor_y"]) for r in layout.row_anchors(rows, items).collect()}
    assert time.time() - start < 60
    assert got == {(1, 0): (20, 20), (1, 1): (None, 40), (1, 2): (None, 60), (1, 3): (None, None), (2, 0): (None, None)}


def test_baseline_counts(spark):
    contours = spark.createDataFrame([("p", 1, 10, 30, 900.0, 4), ("p", 2, 30, 15, 900.0, 4), ("p", 3, 60, 10, 900.0, 3), ("p", 4, 9, 9, 50.0, 4)], "plan_id string, id int, w int, h int, area double, sides int")
    labels = spark.createDataFrame([("p", "Meeting room", 0.9), ("p", "2.4m", 0.8), ("p", "xyz", 0.1)], "plan_id string, text string, confidence double")
    elements = plan_items.plan_elements(contours, labels)
    assert sorted(r["type"] for r in elements.collect()) == ["dimension", "door", "room", "wall", "window"]
    got = {r["code"]: r["qty"] for r in plan_items.baseline_items(elements).collect()}
    assert got == {"FRN-001": 1, "FRN-002": 2, "FIT-001": 1, "FIT-002": 1}


def test_edits(spark):
    rows = spark.createDataFrame([("d", i, f"r{i}", "2", "Nos", "10", "20.00") for i in (1, 2, 3)], "doc_id string, sn int, description string, qty string, unit string, rate string, amount string")
    edits = spark.createDataFrame(
        [("d", 1, "edit", "qty", "5", 1), ("d", 1, "edit", "qty", "3", 2), ("d", 2, "remove", None, None, 3), ("d", 3, "insert", None, None, 4)],
        "doc_id string, sn int, action string, field string, value string, seq int",
    )
    got = plan_items.apply_edits(rows, edits, F.floor(F.col("sn") / 65536)).orderBy("sn").collect()
    assert [(r["sn"], r["description"], r["amount"]) for r in got] == [(1, "r1", "30.00"), (2, "r3", "20.00"), (3, "", "")]
