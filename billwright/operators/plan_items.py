"""Plan items and plan features to line items."""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import AMOUNT, clean_quantity, money, or_else, parse_number
from billwright.functions.text import contains_any, strip_room
from billwright.operators.ordering import number_rows


def default_plan_items(items, include_fitout=False):
    """Fill in location, scope and unit, trim texts, clean quantities."""
    scope = "Fitout" if include_fitout else "Furniture"
    return items.select(
        *[c for c in items.columns if c not in ("location", "scope", "code", "description", "qty", "unit")],
        F.trim(or_else("location", F.lit("General Area"))).alias("location"),
        F.trim(or_else("scope", F.lit(scope))).alias("scope"),
        F.trim(F.coalesce("code", F.lit(""))).alias("code"),
        F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        clean_quantity("qty").alias("qty"),
        F.trim(or_else("unit", F.lit("Nos"))).alias("unit"),
    )


def plan_rows(items, strip_rooms=True):
    """'[location] description' line items; ``strip_rooms=False`` is the value-engineering variant."""
    text = strip_room("description", every=True) if strip_rooms else F.coalesce("description", F.lit(""))
    unit = or_else("unit", F.lit("Nos")) if strip_rooms else F.col("unit")
    return items.withColumn(
        "description", F.concat(F.lit("["), F.col("location"), F.lit("] "), text)
    ).withColumn("unit", unit)


def replicate_tiers(rows, tiers=tuple(rules.TIERS), present=None):
    """One copy of the rows per tier; with ``present`` (doc_id, tier) only for empty tiers."""
    copies = rows.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    if present is None:
        return copies
    return copies.join(present.select("doc_id", "tier").distinct(), ["doc_id", "tier"], "left_anti")


def union_plans(items, file_count=None):
    """Items of several files as one list; locations carry the file name when there are several."""
    if file_count is None:
        counts = items.groupBy("doc_id").agg(F.count_distinct("file").alias("_files"))
        items = items.join(counts, "doc_id")
    else:
        items = items.withColumn("_files", F.lit(file_count))
    tagged = F.concat(F.col("location"), F.lit(" ("), F.col("file"), F.lit(")"))
    return items.withColumn(
        "location", F.when(F.col("_files") > 1, tagged).otherwise(F.col("location"))
    ).drop("_files")


def plan_totals(items):
    """Item count, distinct rooms and total quantity per document."""
    return items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_distinct("location").alias("room_count"),
        F.sum(F.col("qty").cast(AMOUNT)).alias("total_qty"),
    )


def contour_type(w, h, area, sides):
    """Kind of a plan outline from its shape."""
    aspect = F.when(F.col(h) > 0, F.col(w).cast("double") / F.col(h)).otherwise(F.lit(0.0))
    boxy = (F.col(sides) >= 4) & (aspect > 0.3) & (aspect < 3.0)
    usual = (F.col(area) > 500) & (F.col(area) < 50000)
    return (
        F.when(
            boxy & usual,
            F.when(aspect > 1.5, "window").when(aspect < 0.7, "door").otherwise("furniture"),
        )
        .when(boxy, "unknown")
        .when((F.col(sides) <= 3) & ((aspect > 5) | (aspect < 0.2)), "wall")
        .when(F.col(sides) > 8, "fixture")
        .otherwise("unknown")
    )


def label_type(text):
    """Kind of a text label on a plan."""
    text = F.upper(F.coalesce(F.col(text), F.lit("")))
    return (
        F.when(contains_any(text, rules.ROOM_WORDS), "room")
        .when(text.rlike(rules.PLAN_DIMENSION), "dimension")
        .when(contains_any(text, rules.PLAN_FURNITURE_WORDS), "furniture")
        .otherwise("unknown")
    )


def plan_elements(contours, labels):
    """Labels and outlines of known kind (B18). Outlines below 100 units of area are noise."""
    from_labels = labels.select(
        "plan_id",
        label_type("text").alias("type"),
        F.upper("text").alias("label"),
        F.lit("ocr").alias("source"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    kind = contour_type("w", "h", "area", "sides")
    from_contours = contours.where("area >= 100").select(
        "plan_id",
        kind.alias("type"),
        F.concat(F.initcap(kind), F.lit(" #"), F.col("id").cast("string")).alias("label"),
        F.lit("contour").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return from_labels.unionByName(from_contours).where("type <> 'unknown'")


def baseline_items(elements, table=rules.BASELINE_ITEMS):
    """Estimated line items from element counts (B19). The rule table is a handful of literals."""
    counts = elements.groupBy("plan_id", "type").agg(F.count(F.lit(1)).alias("n"))
    names = ("type", "location", "scope", "code", "description", "divisor", "least")
    rules_array = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in table])
    return (
        counts.withColumn("r", F.explode(F.filter(rules_array, lambda r: r["type"] == F.col("type"))))
        .select(
            "plan_id",
            "r.location",
            "r.scope",
            "r.code",
            "r.description",
            F.greatest(F.col("r.least").cast("bigint"), F.floor(F.col("n") / F.col("r.divisor"))).alias("qty"),
            F.lit("Nos").alias("unit"),
        )
    )


def apply_edits(rows, edits, block):
    """Cell edits, inserted and removed rows, then renumbering.

    ``rows``: doc_id, sn, description, qty, unit, rate, amount. ``edits``: doc_id, sn, action
    ('edit', 'insert' after sn, 'remove'), field, value, seq (the last edit of a cell wins). An edit of qty or rate recomputes amount.
    """
    fields = ["description", "qty", "unit", "rate", "amount"]
    changes = (
        edits.where("action = 'edit'")
        .groupBy("doc_id", "sn")
        .agg(*[F.max_by("value", F.when(F.col("field") == f, F.col("seq"))).alias(f"new_{f}") for f in fields])
    )
    removed = edits.where("action = 'remove'").select("doc_id", "sn").distinct()
    inserted = edits.where("action = 'insert'").select(
        "doc_id", "sn", F.lit(1).alias("_after"), *[F.lit("").alias(f) for f in fields]
    )
    edited = rows.join(changes, ["doc_id", "sn"], "left")
    for f in fields:
        edited = edited.withColumn(f, F.coalesce(f"new_{f}", F.col(f).cast("string"), F.lit("")))
    qty, rate = parse_number("qty"), parse_number("rate")
    touched = F.col("new_qty").isNotNull() | F.col("new_rate").isNotNull()
    edited = edited.withColumn(
        "amount",
        F.when(touched & qty.isNotNull() & rate.isNotNull(), money(qty * rate).cast("string")).otherwise(
            F.col("amount")
        ),
    )
    kept = edited.join(removed, ["doc_id", "sn"], "left_anti").select(
        "doc_id", "sn", F.lit(0).alias("_after"), *fields
    )
    return (
        number_rows(kept.unionByName(inserted), ["doc_id"], ["sn", "_after"], "new_sn", block)
        .drop("sn", "_after")
        .withColumnRenamed("new_sn", "sn")
    )


