from decimal import Decimal

from pyspark.sql import functions as F

from billwright.functions import numbers, tagging, text, urls


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_numbers(spark):
    cases = {"1,250.00": "1250.0000", "12 Nos": "12.0000", "-3.5x": "-3.5000", ".5": "0.5000", "1e3": "1000.0000"}
    for raw, want in cases.items():
        assert one(spark, numbers.parse_number(F.lit(raw))) == Decimal(want)
    for raw in ("", "abc", "-"):
        assert one(spark, numbers.parse_number(F.lit(raw))) is None
    quantities = {"": 1, "two": 2, "12 Nos": 12, "some": 1, "7": 7}
    for raw, want in quantities.items():
        assert one(spark, numbers.clean_quantity(F.lit(raw))) == want
    assert one(spark, numbers.nonzero_text(F.lit("0"))) == ""
    assert one(spark, numbers.nonzero_text(F.lit("12 Nos"))) == ""
    assert one(spark, numbers.nonzero_text(F.lit("2.50"))) == "2.5"
    assert one(spark, numbers.parse_loose_number(F.lit("OMR 1,200.5"))) == Decimal("1200.5")
    assert one(spark, numbers.money(F.lit("1.005").cast("decimal(18,4)"))) == Decimal("1.01")


def test_display(spark):
    assert one(spark, numbers.display(F.lit("1234.5"), F.lit("Rate"))) == "1,234.50"
    assert one(spark, numbers.display(F.lit("1234.5678"), F.lit("Amount"))) == "1,234.568"
    assert one(spark, numbers.display(F.lit("1234"), F.lit("Total Qty"))) == "1,234"
    assert one(spark, numbers.display(F.lit("45 series"), F.lit("Rate"))) == "45 series"


def test_text(spark):
    assert one(spark, text.model_key(F.lit("Aston - Executive chair #1480671"))) == "aston executive chair"
    assert one(spark, text.strip_variant(F.lit("Wind Task #12"))) == "Wind Task"
    assert one(spark, text.brand_name(F.lit(" B&T\n Design "))) == "B&T Design"
    assert one(spark, text.brand_name(F.lit(" "))) == "Unnamed Brand"
    assert one(spark, text.enriched_description(F.lit("Chair"), F.lit("2"), F.lit(""))) == "Chair | Qty: 2"
    assert one(spark, text.enriched_description(F.lit("Chair"), F.lit(""), F.lit(""))) == "Chair"
    assert one(spark, text.strip_room(F.lit("[A] [B] Carpet"), every=True)) == "Carpet"
    assert one(spark, text.strip_room(F.lit("[A] [B] Carpet"))) == "[B] Carpet"
    assert one(spark, text.variant_model(F.lit("Tela"), F.lit("https://x/sokoa-tela-123/"))) == "Tela #123"
    assert one(spark, text.tidy_list(F.array(F.lit(" a "), F.lit("b\n c")))) == "a. b c"


def test_urls(spark):
    base = F.lit("https://h.com/x/y?q=1")
    cases = {"/a/../b": "https://h.com/b", "k": "https://h.com/x/k", "//c.com/z": "https://c.com/z",
             "?p=2": "https://h.com/x/y?p=2", "https://o.com/1": "https://o.com/1", "../k": "https://h.com/k"}
    for href, want in cases.items():
        assert one(spark, urls.absolute(F.lit(href), base)) == want
    assert one(spark, urls.image_or_logo(F.lit("http://x/a.png"), F.lit("logo"))) == "logo"
    assert one(spark, urls.is_trusted_image(F.lit("https://knoll.com/a.png?x"), F.lit("")))
    assert not one(spark, urls.is_product_image(F.lit("https://x.com/hero.png")))
    assert one(spark, urls.is_product_url(F.lit("https://x.com/chairs/aeron.html")))
    assert one(spark, urls.logo_domain(F.lit("Herman Miller"), F.lit(None).cast("string"))) == "hermanmiller.com"
    assert one(spark, urls.logo_domain(F.lit("N/A"), F.lit(""))) is None


def test_tagging(spark):
    assert one(spark, tagging.category_of(F.lit("HEAD OF CHAIR")))["sub"] == "Executive Chairs"
    assert one(spark, tagging.category_of(F.lit("reception counter"))) ["sub"] == "Reception Desks"
    assert one(spark, tagging.category_of(F.lit("counter stool")))["sub"] == "Stools"
    assert one(spark, tagging.seniority(F.lit("CEO desk"))) == 4
    size = one(spark, tagging.size_of(F.lit("desk 80 X 160")))
    assert (size["width"], size["depth"]) == (1600, 800)
    size = one(spark, tagging.size_of(F.lit("table R:90")))
    assert (size["width"], size["depth"]) == (900, 900)
    kept = tagging.is_kept_product(F.lit(""), F.lit("M"), F.lit("leather swatch"), F.lit(""), F.lit(""), F.lit("https://x/a.png"))
    assert not one(spark, kept)
    k = one(spark, tagging.keyword_category(F.lit("sofa lounge armchair"), F.lit("premium")))
    assert (k["category"], k["sub_category"], k["rank"]) == ("Lounge & Reception", "Sofa", 3)
    assert one(spark, tagging.tier_of(F.lit("Premium"))) == "high"
    assert one(spark, tagging.tier_from_file(F.lit("acme-budgetary.json"))) == "budgetary"
