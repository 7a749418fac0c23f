import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from billwright.operators.bloom import bloom_filter, may_hold
from billwright.sources import brands, catalogs, documents, pages
from billwright.queries import pages as page_queries
from billwright.sources.pages import page_elements
from billwright.sources.responses import parse_responses
from billwright.operators import harvest


def folder(files):
    path = tempfile.mkdtemp(prefix="spark-")
    for name, text in files.items():
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    return path


def test_brand_documents(spark):
    first = folder({
        "a.json": json.dumps({"id": 17, "name": "Arper", "budgetTier": "high", "products": [{"model": "Sky", "price": 12.5}, {"model": "Oak"}]}, indent=1),
        "b.json": "{not json",
        "c.json": json.dumps({"name": "no id", "products": []}),
    })
    second = folder({"a.json": json.dumps({"id": "17", "name": "Other"}), "d.json": json.dumps({"id": "x", "name": "Flat", "products": {"a": 1}})})
    docs = brands.read_brand_documents(spark, [first, second])
    assert {r["brand_id"]: r["name"] for r in docs.collect()} == {"17": "Arper", "x": "Flat"}
    flat = brands.flatten_products(docs).orderBy("brand_id", "pos").collect()
    assert [(r["brand_id"], r["pos"], r["model"]) for r in flat] == [("17", 0, "Sky"), ("17", 1, "Oak"), ("x", None, None)]
    assert float(flat[0]["price"]) == 12.5


def test_documents_as_products(spark):
    """A document is walked product by product, whatever its layout and the size of the pieces read."""
    big = {"name": "B", "products": [{"model": f"M{i}", "price": i, "description": "é" * 40} for i in range(4000)], "budgetTier": "high", "id": "7"}
    first = folder({"a.json": json.dumps(big, indent=2), "b.json": '{"id": "8", "products": [{"model": "x"}', "c.json": '{"id": "9", "products": "none"}', "d.json": "[1]", "e.json": ""})
    second = folder({"x.json": json.dumps({"id": "7", "products": [{"model": "old"}]}), "y.json": '{"id":"10","budgetTier":"mid","products":[{"model":"one"},5]}', "z.txt": "{}"})
    rows = documents.scan_brands(spark, [first, second], partitionBytes="1")
    got = {(r["brand_id"], r["pos"]): (r["tier"], r["model"], r["price"]) for r in rows.collect()}
    assert len(got) == 4000 + 3 and got["7", 3999] == ("high", "M3999", "3999") and got["9", None] == (None, None, None)
    assert got["10", 0] == ("mid", "one", None) and got["10", 1] == ("mid", None, None)
    high = rows.where("tier = 'high'")
    assert high.count() == 4000 and rows.where("tier = 'none'").count() == 0


def test_header_filter_skips_documents():
    path = folder({"a.json": '{"id": "1", "budgetTier": "high", "products": [{"model": "m"}]}', "b.json": '{"id": "2", "budgetTier": "mid", "products": [{"model": "m"}]}'})
    reader = documents.BrandReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    other = GreaterThan(("pos",), 0)
    assert other in list(reader.pushFilters([EqualTo(("tier",), "high"), other]))
    assert [row[2] for part in reader.partitions() for row in reader.read(part)] == ["1"]


def test_pages_are_read_in_pieces():
    html = "<html><title>T &amp; é</title><body><script>if (a < b) { x('</div>') }</script><div class='content'> a <p>one<p>two <b>deep</b> &lt;x&gt;" + "".join(
        f"<ul><li>item {i}<li><a href='/{i}'>link&nbsp;{i}</a></ul>" for i in range(300)
    ) + "</div></body>"
    whole = sorted((e for part in pages._read(html, 1 << 30) for e in part), key=lambda e: e.node)
    seen = lambda es: [(e.node, e.last, e.parent, e.tag, e.attrs, e.ancestors, e.flags, "".join(e.parts) if e.parts is not None else None, e.size) for e in es]
    for piece in (1, 7, 100):
        assert seen(sorted((e for part in pages._read(html, piece) for e in part), key=lambda e: e.node)) == seen(whole)
    for e in whole:
        assert e.last == max([x.node for x in whole if e.node in x.ancestors], default=e.node)
        if e.parts is not None:
            assert e.size == len("".join(e.parts).strip())


def test_long_page_in_bounded_frames():
    """A page of 40 MB leaves in frames; only one frame and the open elements are held."""
    import tracemalloc

    import pyarrow as pa

    body = "".join(f'<div class="card"><h2>Chair {i}</h2><img src="/{i}.jpg"><a href="/p/{i}">more about it</a></div>' for i in range(1000))
    html = "<html><body>" + body * 400 + "</body></html>"
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["u", "v"], "html": [html, "<p>x"]})
    tracemalloc.start()
    rows = largest = 0
    for frame in pages._parse_batches([batch]):
        rows, largest = rows + frame.num_rows, max(largest, frame.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400 * 4000 + 2 + 1 and largest <= pages.FRAME_ROWS and peak < len(html) + 40e6


def test_frontier_is_exact(spark):
    found = spark.createDataFrame([(f"https://x/{i % 700}",) for i in range(2000)] + [(None,)], "link string")
    visited = spark.createDataFrame([(f"https://x/{i}",) for i in range(350, 3000)] + [(None,)], "url string")
    got = [r["link"] for r in harvest.frontier(found, visited).collect()]
    assert sorted(got, key=str) == sorted([f"https://x/{i}" for i in range(350)] + [None], key=str)
    assert harvest.frontier(found, visited.limit(0)).count() == 701


def test_bloom_filter_passes_few_others(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    tested = may_hold(spark.range(20000).select(F.col("id").cast("string").alias("key")), bloom_filter(keys))
    held = tested.groupBy((F.col("key").cast("int") < 5000).alias("in")).agg(F.sum(F.col("_maybe").cast("int")).alias("n")).collect()
    counts = {r["in"]: r["n"] for r in held}
    assert counts[True] == 5000 and counts[False] < 600


def test_hierarchy(spark):
    kind = "brand_id string, brand string, tier string, categories array<struct<name:string,subCategories:array<struct<name:string,families:array<struct<name:string,products:array<struct<model:string,price:string>>>>>>>>"
    df = spark.createDataFrame([("1", "B", "mid", [("Seating", [("Chairs", [("F", [("M1", "3"), ("M2", "4")])])])])], kind)
    got = brands.flatten_hierarchy(df).collect()
    assert [(r["main_category"], r["sub_category"], r["family"], r["model"]) for r in got] == [("Seating", "Chairs", "F", "M1"), ("Seating", "Chairs", "F", "M2")]


def test_rate_card_and_writers(spark):
    path = folder({"card.csv": 'Category,Sub-Category,Model_Code,Item_Description,UOM,Unit_Rate_OMR,Image_URL\nFloor,Stone,MA-201,"Marble, 20mm thick",m2,26,http://x\n'})
    card = catalogs.read_rate_card(spark, path)
    row = card.first()
    assert (row["family"], row["model"], row["description"], float(row["price"])) == ("MA", "MA-201", "Marble, 20mm thick", 26.0)
    out = tempfile.mkdtemp(prefix="spark-") + "/catalog"
    products = spark.createDataFrame([("B & T", "mid", "one"), ("Arper", "high", "two")], "brand string, tier string, model string")
    brands.write_catalog(products, out)
    brands.write_catalog(products.where("brand = 'Arper'").withColumn("model", F.lit("three")), out)
    got = {(r["brand_slug"], r["tier_key"], r["model"]) for r in spark.read.parquet(out).collect()}
    assert got == {("b___t", "mid", "one"), ("arper", "high", "three")}
    export = tempfile.mkdtemp(prefix="spark-") + "/export"
    full = card.withColumn("product_url", F.lit(""))
    catalogs.write_export(full, export)
    assert spark.read.csv(export, header=True).columns == list(catalogs.EXPORT_COLUMNS.values())


def test_responses(spark):
    raw = [
        ("clean", '{"items":[{"description":"a","qty":"1"}]}'),
        ("fenced", '```json\n{"rows":[{"description":"b"}]}\n```'),
        ("preamble", 'Sure! {"items": [{"description":"c"}]} bye'),
        ("control", '{"items":[{"description":"d\x01"}]}'),
        ("cut", '{"items":[{"description":"e"},{"description":"f"}'),
        ("odd", '{"items":[{"description":"g'),
        ("none", "no json here"),
    ]
    rows, rejects = parse_responses(spark.createDataFrame(raw, "response_id string, raw string"))
    got = {}
    for r in rows.collect():
        got.setdefault(r["response_id"], []).append(r["description"])
    assert got == {"clean": ["a"], "fenced": ["b"], "preamble": ["c"], "control": ["d"], "cut": ["e", "f"], "odd": ["g"]}
    assert [r["response_id"] for r in rejects.collect()] == ["none"]


PAGE = """<html><head><title>Acme | Home</title><meta name="description" content="A page about chairs for the office">
<script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"LD One","image":{"url":"/ld.png"},"url":"/p/one"},{"@type":"Other"}]}</script>
<script type="application/ld+json">{broken</script></head><body><h1>Collections by Acme Studio</h1>
<nav><ul class="menu"><li><a href="/chairs">Chairs (12)</a></li><li><a href="/contact">Contact</a></li></ul></nav>
<div class="grid"><div class="product-card"><a href="/p/a"><h3>Alpha</h3></a><img src="/a.jpg" srcset="/a1.jpg 1x, /a2.jpg 2x"></div>
<div class="product-card"><a href="/p/b"><h3>ALPHA</h3></a><img data-src="/b.jpg"></div>
<div class="product-card"><a href="/p/c"><h3>Gamma</h3></a><img src="/icon.png"></div>
<div class="product-card"><a href="/p/d"><h3>Delta</h3></a><picture><source srcset="/d.webp 1x"></picture></div></div>
<div class="pagination"><a href="?page=2">2</a></div></body></html>"""


def test_page_operators(spark):
    pages = spark.createDataFrame([(1, "https://www.acme.com/x", PAGE)], "page_id bigint, url string, html string")
    elements = page_elements(pages).cache()
    scores = harvest.container_scores(elements).collect()
    assert scores[0]["selector"] == ".product-card" and scores[0]["elements"] == 4
    cards = {r["model"]: (r["image_url"], r["product_url"]) for r in harvest.page_cards(elements).collect()}
    assert cards == {"Alpha": ("https://www.acme.com/a2.jpg", "https://www.acme.com/p/a"), "Delta": ("https://www.acme.com/d.webp", "https://www.acme.com/p/d")}
    info = harvest.brand_info(elements).first()
    assert (info["title_name"], info["name"], info["host_name"]) == ("Acme", "Acme Studio", "acme")
    kinds = {r["link"]: r["kind"] for r in harvest.typed_links(elements).collect()}
    assert kinds["https://www.acme.com/x?page=2"] == "pagination" and kinds["https://www.acme.com/contact"] == "excluded"
    assert kinds["https://www.acme.com/p/a"] == "product" and kinds["https://www.acme.com/chairs"] == "category"
    assert [(r["name"], r["products"]) for r in harvest.counted_categories(harvest.links(elements)).collect()] == [("Chairs", 12)]
    declared = harvest.structured_products(pages).collect()
    assert [(r["model"], r["product_url"], r["image_url"]) for r in declared] == [("LD One", "https://www.acme.com/p/one", "https://www.acme.com/ld.png")]
    tree = harvest.menu_tree(elements).collect()
    assert [(r["main_category"], r["sub_category"]) for r in tree] == [("Chairs (12)", "Chairs (12)")]


def test_cut_references_stay_text(spark):
    html = '<title>A &amp; B &ampx; C&amp</title><a href="/q?a=1&copy=2&amp;b">&#65; &#65 &quot;</a><script type="application/ld+json">{"n": "x &amp y"}</script>'
    pages = spark.createDataFrame([(1, "https://a.com", html)], "page_id long, url string, html string")
    rows = {r["tag"]: r for r in page_elements(pages, closed_references=True).collect()}
    assert rows["title"]["text"] == "A & B &ampx; C&amp"
    assert rows["a"]["attrs"] == {"href": "/q?a=1&copy=2&b"} and rows["a"]["text"] == 'A &#65 "'
    assert rows["script"]["text"] == '{"n": "x &amp y"}'
    assert {r["tag"]: r["text"] for r in page_elements(pages).collect()}["title"] == "A & B &x; C&"


def test_shop_and_detail_pages_never_share_a_number(spark, tmp_path):
    keys = [k + shift for shift in (0, 12_000_000_000) for k in range(24)]
    spark.createDataFrame([(k, "blue bolt", "Brand#1", "SMALL", 3) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    pages = page_queries.site_pages(spark, str(tmp_path)).select("page_id", "url").collect()
    assert len({r["page_id"] for r in pages}) == len(pages) == len(keys) + 4
    shops = [r["page_id"] for r in pages if "/product-category/" in r["url"]]
    assert max(shops) < min(r["page_id"] for r in pages if "/p/" in r["url"])


def test_a_product_listed_with_two_images_stays_twice(spark, tmp_path):
    """A page of few cards lists part 2 as a card and as a block, with another image."""
    spark.createDataFrame([(k, "blue bolt", "Brand#1", "SMALL", k) for k in (1, 2)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = page_queries.harvest_site_products(spark, str(tmp_path)).collect()
    images = [r["image_url"].rsplit(".com", 1)[1] for r in rows if r["model"] == "ergonomic chair 2"]
    assert sorted(images) == ["/big/2.jpg", "/s.jpg"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_pages_of_a_small_file_are_parsed_in_many_tasks(spark):
    """The parts lie in one row group, which one task would read."""
    from billwright.queries.pages import product_pages, site_pages

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet")
    assert parts.rdd.getNumPartitions() == 1
    for pages in (product_pages(spark, sf), site_pages(spark, sf).where("html like '%<h1>%'")):
        elements = page_elements(pages).where("tag = 'h1'")
        tasks = [r["n"] for r in elements.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(tasks) >= 4 and sum(tasks) == parts.count() and max(tasks) < 0.5 * parts.count()
