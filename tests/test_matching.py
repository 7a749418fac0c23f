"""The model matcher against a literal brute force, and the attribute matcher on its known outcomes."""

import random
import re

from billwright import rules
from billwright.operators import attributes, dedup, matching


def key(s):
    s = re.sub(r"#\d+", "", (s or "").lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]", " ", s)).strip()


def brute(products, model, category):
    t = key(model)
    if not t:
        return None
    for p in products:
        if key(p["model"]) == t:
            return p["pos"]
    found = [p for p in products if t in key(p["model"]) or key(p["model"]) in t]
    if not found:
        def near(p):
            words = key(p["model"]).split(" ")
            return any(w in words or any(s in words for s in rules.SYNONYMS.get(w, [])) for w in t.split(" "))
        found = [p for p in products if near(p)]
    if category and len(category) > 2:
        c = category.lower().strip()
        fit = [p for p in found if any(c in x or x in c for x in (p["main_category"].lower(), p["sub_category"].lower()))]
        found = fit or found
    if not found:
        return None
    usable = lambda ws: [w for w in ws if len(w) > 2 or w.isdigit()]
    tw = set(usable(t.split(" ")))
    if not tw:
        return found[0]["pos"]
    best, score = None, 0.0
    for p in found:
        every = key(p["model"]).split(" ")
        pw = usable(every)
        shared = sum(w in tw for w in pw)
        s = shared / max(len(tw), len(pw))
        if shared < len(tw):
            s += sum(0.25 for w in t.split(" ") if w in tw and w not in pw and any(x in every for x in rules.SYNONYMS.get(w, [])))
        if s > score:
            best, score = p["pos"], s
    return best if score >= 0.5 else None


def test_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["sky", "task", "chair", "stool", "desk", "table", "bench", "sofa", "x", "80", "a1", "oak", "cabinet", "storage", "lounge"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) + rng.choice(["", " #12", "!"])
    cats = ["Seating", "Tables", "", "Storage units"]
    products = [
        {"brand_id": b, "pos": i, "model": name(), "main_category": rng.choice(cats), "sub_category": rng.choice(cats)}
        for b in ("A", "B", "C") for i in range(30 if b != "C" else 6)
    ]
    for p in products:
        if p["brand_id"] != "A" and not key(p["model"]):
            p["model"] = "oak sky 80"
    targets = [
        {"target_id": i, "brand_id": rng.choice("ABCD"), "model": name(), "category": rng.choice(["", "Seating", "table", "xx", "storage"])}
        for i in range(400)
    ]
    targets += [{"target_id": 400 + i, "brand_id": "E", "model": t, "category": ""} for i, t in enumerate(["chair chair red big tall wide", "chair chair x red"])]
    products += [{"brand_id": "E", "pos": i, "model": m, "main_category": "", "sub_category": ""} for i, m in enumerate(["oak", "stool green", "stool red"])]
    got = matching.match_models(
        spark.createDataFrame(targets, "target_id int, brand_id string, model string, category string"),
        spark.createDataFrame(products, "brand_id string, pos int, model string, main_category string, sub_category string"),
    ).collect()
    by_brand = {b: [p for p in products if p["brand_id"] == b] for b in "ABCDE"}
    stages = set()
    for r in got:
        want = brute(by_brand[r["brand_id"]], r["model"], r["category"])
        assert r["match_pos"] == want, r
        stages.add(r["match_stage"])
    assert len(got) == 402 and {1, 2, 3} <= stages


def test_synonym_only_match(spark):
    products = spark.createDataFrame([("A", 0, "bench", "", ""), ("A", 1, "other", "", "")], "brand_id string, pos int, model string, main_category string, sub_category string")
    targets = spark.createDataFrame([("A", "desk sofa", "")], "brand_id string, model string, category string")
    r = matching.match_models(targets, products).first()
    assert (r["match_pos"], r["match_stage"], r["match_score"]) == (0, 3, 0.5)


CATALOG = [
    ("Paragon HIGH", "High-back executive chair leather", "Office Seating", "Executive Chairs"),
    ("Cila Lobby", "Elegant lobby armchair soft seating", "Office Seating", "Lounge Chairs"),
    ("Sky Round 90", "Sky Lounge Table R:90 coffee table", "Desk & Table", "Coffee Tables"),
    ("Artist Special", "Professional Theatre Artist Chair for studios", "Office Seating", "Specialist Chairs"),
    ("Wind Task", "Ergonomic mesh staff chair", "Office Seating", "Staff Chairs"),
    ("Master Desk", "Staff Workstation 1600x800 white", "Desk & Table", "Desk System"),
    ("Executive North", "Head of Desk 2000x1000 veneer", "Desk & Table", "Manager Tables"),
    ("Reception X", "Reception Desk with counter", "Desk & Table", "Reception Desks"),
    ("Office Pod S", "Acoustic Phone Pod for meetings", "Acoustic Solutions", "Office Pods"),
    ("Basic Operative", "Budgetary staff chair assistant chair", "Office Seating", "Staff Chairs"),
    ("Secretarial Unit", "Secretary Desk 1600x800 elegant", "Desk & Table", "Single Desks"),
    ("Budget Desk", "Simple staff workstation 1200x600", "Desk & Table", "Single Desks"),
]
KNOWN = {
    "HEAD OF CHAIR": "Paragon HIGH",
    "STAFF CHAIR": "Wind Task",
    "SKY LOUNGE TABLE R:90": "Sky Round 90",
    "STAFF WORKSTATION 2 80 X 160": "Master Desk",
    "STAFF WORKSTATION 2 80 X 160 NO PARTITION": "Master Desk",
    "SECRETARY DESK 80 X 160": "Secretarial Unit",
    "HEAD OF DESK 80 X 160": "Executive North",
    "LOBBY CHAIR": "Cila Lobby",
    "ASSISTANT CHAIR": "Basic Operative",
    "THEATRE ARTIST CHAIR": "Artist Special",
}


def test_attribute_matcher_known_outcomes(spark):
    products = spark.createDataFrame([(i, *row) for i, row in enumerate(CATALOG)], "catalog_pos int, model string, description string, main_category string, sub_category string")
    lines = spark.createDataFrame([(d,) for d in KNOWN] + [("nothing known",)], "description string")
    got = {r["description"]: r["catalog_pos"] for r in attributes.match_by_attributes(lines, products).collect()}
    assert got.pop("nothing known") is None
    assert {d: CATALOG[p][0] if p is not None else None for d, p in got.items()} == KNOWN


def test_category_priority_replay(spark):
    rng = random.Random(5)
    kinds = [("Chairs", "Executive"), ("Products", "Executive"), ("Chairs", "Chairs"), ("Products", "Products")]
    rows = []
    for u in range(200):
        for pos in range(rng.randint(1, 7)):
            main, sub = rng.choice(kinds)
            rows.append((0, u * 10 + pos, main, sub, f"https://x/P{u}", "https://x.com/photo.png"))
    df = spark.createDataFrame(rows, "harvest_id int, pos int, main_category string, sub_category string, product_url string, image_url string")
    kept = {}
    for r in rows:
        specific, generic = r[2] != r[3], r[2] == "Products"
        old = kept.get(r[4])
        if old is None or (specific and old[2] == old[3]) or (not generic and old[2] == "Products"):
            kept[r[4]] = r
    got = {r["product_url"]: r["pos"] for r in dedup.prefer_specific(df).collect()}
    assert got == {u: r[1] for u, r in kept.items()}


def test_snap_takes_highest_price(spark):
    products = spark.createDataFrame(
        [("A", 0, "Sky chair", "10"), ("A", 1, "Sky chair wide", "30"), ("A", 2, "", "5"), ("A", 3, "Oak", "99")], "brand_id string, pos int, model string, price string"
    )
    wanted = spark.createDataFrame([("A", "sky chair"), ("A", "zzz"), ("A", "")], "brand_id string, model string")
    got = {r["model"]: r["snap_pos"] for r in matching.snap_to_catalog(wanted, products).collect()}
    assert got == {"sky chair": 1, "zzz": 2, "": 3}


def test_candidates_of_a_name_are_asked_once(spark, monkeypatch):
    """However many lines name a brand and a model, the matcher sees the name once; the first candidate that finds something wins."""
    from billwright.operators import matching
    from billwright.plans.auto_match import auto_match

    asked = []
    match = matching.match_models
    monkeypatch.setattr(matching, "match_models", lambda targets, products: asked.append(targets.count()) or match(targets, products))
    lines = [("d", sn, tier, "chair" if sn < 40 else "sofa", sn, 1, brand, order) for sn in range(50) for tier in ("mid", "high") for order, brand in enumerate(("Nobody", "Acme", "New"))]
    candidates = spark.createDataFrame(lines, "doc_id string, sn int, tier string, description string, qty int, rate int, candidate_brand string, candidate_order int")
    identified = candidates.selectExpr("candidate_brand", "description", "'success' status", "'' brand", "description model", "'' main_category").distinct()
    brands = spark.createDataFrame([("a", "acme", "mid", 1, None)], "brand_id string, name string, tier string, brand_order int, logo string")
    products = spark.createDataFrame([("a", 0, "Chair", "Seating", "", "", "d", 5)], "brand_id string, pos int, model string, main_category string, sub_category string, family string, description string, price int")
    found = spark.createDataFrame([("new", "chair", "", "http://x/y.jpg", "3", "made")], "brand string, model string, main_category string, image_url string, price string, description string")
    got = {(r["sn"], r["tier"]): (r["status"], r["source"], r["brand"], r["qty"]) for r in auto_match(candidates, identified, brands, products, found).collect()}
    assert asked == [10]
    assert len(got) == 100
    for sn in range(50):
        own = ("success", "local-database", "Acme", sn), ("success", "ai-discovery-hardened", "New", sn)
        assert (got[sn, "mid"], got[sn, "high"]) == (own if sn < 40 else (("no_match", None, None, sn),) * 2)
