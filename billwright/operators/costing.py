"""Markup, exchange rates, VAT, totals, offers and tier comparison.

Money is decimal from the first operation on and rounded half up.
"""

from pyspark.sql import functions as F

from billwright import rules
from billwright.functions.numbers import AMOUNT, blank, money, number_in, or_else, parse_number
from billwright.operators.sheets import role_value

FACTOR = "decimal(18,10)"


def fx_rate(from_currency, to_currency, rates=rules.USD_RATES):
    """Cross rate from a dollar table: 1 when equal, unknown currencies count as 1, 4 decimals (A5)."""
    def per_usd(c):
        expr = None
        for code, rate in rates.items():
            value = F.lit(rate).cast("decimal(12,6)")
            expr = F.when(F.col(c) == code, value) if expr is None else expr.when(F.col(c) == code, value)
        return expr.otherwise(F.lit("1").cast("decimal(12,6)"))

    cross = F.round(per_usd(to_currency) / per_usd(from_currency), 4).cast("decimal(12,4)")
    return F.when(F.col(from_currency) == F.col(to_currency), F.lit("1").cast("decimal(12,4)")).otherwise(cross)


def factors(profit=0, freight=0, customs=0, installation=0, vat=5, exchange_rate="0.385",
            from_currency="USD", to_currency="OMR"):
    """Costing factors of one offer as literals: the markup multiplier and the VAT share."""
    from decimal import Decimal

    margin = sum(Decimal(str(x)) for x in (profit, freight, customs, installation)) / 100
    return {
        "multiplier": str(Decimal(str(exchange_rate)) * (1 + margin)),
        "vat": str(Decimal(str(vat)) / 100),
        "vat_percent": str(vat),
        "currency": to_currency,
        "from_currency": from_currency,
    }


def _multiplier(f):
    return F.lit(f["multiplier"]).cast(FACTOR)


def extracted_summary(table, roles=None):
    """Totals of rate, amount and quantity and count of readable amounts per document (A1).

    Rows with neither quantity, rate nor unit are skipped; null when there is no money. Without ``roles`` the table carries them.
    """
    text = {r: F.trim(role_value(r)) for r in ("qty", "rate", "unit", "amount")}
    joined = table if roles is None else table.join(roles, "doc_id")
    rows = joined.select(
        "doc_id",
        ((text["qty"] != "") | (text["rate"] != "") | (text["unit"] != "")).alias("_item"),
        *[parse_number(text[r]).alias(r) for r in ("qty", "rate", "amount")],
    )

    def total(c):
        return F.coalesce(F.sum(F.when(F.col("_item"), F.col(c))), F.lit(0))

    sums = rows.groupBy("doc_id").agg(
        total("rate").alias("total_rate"),
        total("amount").alias("total_amount"),
        total("qty").alias("total_qty"),
        F.count(F.when(F.col("_item"), F.col("amount"))).alias("item_count"),
    )
    has_money = (F.col("total_amount") > 0) | (F.col("total_rate") > 0)
    return sums.select(
        "doc_id",
        F.when(has_money, money("total_rate")).alias("total_rate"),
        F.when(has_money, money("total_amount")).alias("total_amount"),
        F.when(has_money, F.round("total_qty", 0).cast("bigint")).alias("total_qty"),
        F.when(has_money, F.col("item_count")).alias("item_count"),
    )


def row_markup(rows, f, recompute_amount=True):
    """New rate from the base price; ``recompute_amount=False`` leaves the stored amount alone (A2)."""
    base = F.col("base_price").cast(AMOUNT)
    costed = money(base * _multiplier(f))
    marked = F.coalesce(base > 0, F.lit(False))
    out = rows.withColumn("_marked", marked).withColumn("_rate", costed)
    if recompute_amount:
        exact, qty = base * _multiplier(f), F.coalesce(number_in(rows, "qty"), F.lit(0))
        amount = money(exact.cast("decimal(24,8)") * qty.cast("decimal(12,4)"))
        out = out.withColumn("amount", F.when(F.col("_marked"), amount).otherwise(number_in(rows, "amount")))
    rate = F.when(F.col("_marked"), F.col("_rate")).otherwise(number_in(rows, "rate"))
    return out.withColumn("rate", rate).drop("_marked", "_rate")


def cost_table(table, money_cols, f):
    """Every readable number in a money column times the multiplier, two decimals (A3). Without ``money_cols`` the table carries them."""
    def costed(k, v):
        value = parse_number(v)
        hit = F.array_contains(F.col("money_cols"), k) & value.isNotNull()
        return F.when(hit, money(value * _multiplier(f)).cast("string")).otherwise(v)

    joined = table if money_cols is None else table.join(money_cols, "doc_id", "left")
    return (
        joined
        .withColumn("money_cols", F.coalesce("money_cols", F.array().cast("array<int>")))
        .withColumn("cells", F.transform_values("cells", costed))
        .drop("money_cols")
    )


def line_amount(rows, basis="costed"):
    """Amount of one row under one of the three bases (A4)."""
    stored = number_in(rows, "amount").cast("decimal(24,8)")
    if basis == "costed":
        return F.coalesce(stored, F.lit(0))
    qty, rate = F.coalesce(number_in(rows, "qty"), F.lit(0)), F.coalesce(number_in(rows, "rate"), F.lit(0))
    product = (qty * rate).cast("decimal(24,8)")
    if basis == "stored_else_product":
        return F.when(blank(F.col("amount").cast("string")), product).otherwise(F.coalesce(stored, F.lit(0)))
    return product


def totals(rows, f, keys=("doc_id",), basis="costed"):
    """Subtotal, VAT and grand total per key (A4)."""
    sums = rows.groupBy(*keys).agg(F.sum(line_amount(rows, basis)).alias("_sum"), F.count(F.lit(1)).alias("lines"))
    vat = F.lit(f["vat"]).cast("decimal(8,6)")
    exact = F.col("_sum").cast("decimal(24,8)")
    return sums.select(
        *keys,
        "lines",
        money(exact).alias("subtotal"),
        money(exact * vat).alias("vat_amount"),
        money(exact + (exact * vat)).alias("grand_total"),
        F.lit(f["currency"]).alias("currency"),
    )


def amount_of(qty="qty", rate="rate"):
    """Quantity times rate; null when either is unreadable."""
    return money(parse_number(qty) * parse_number(rate))


def fitout_amount(price="price", qty="qty"):
    """Price rounded up to a whole number first; without a quantity the price itself."""
    whole = F.ceil(F.coalesce(parse_number(price), F.lit(0))).cast("decimal(18,0)")
    return F.when(blank(F.col(qty).cast("string")), whole.cast("decimal(18,2)")).otherwise(
        money(F.coalesce(parse_number(qty), F.lit(0)) * whole)
    )


def compare_tiers(rows, columns=("selected_brand", "selected_model", "rate")):
    """One line per item with the three tiers side by side.

    Items and their texts come from the first tier that has rows in the document.
    """
    order = F.create_map(*[x for i, t in enumerate(rules.TIERS) for x in (F.lit(t), F.lit(i))])
    ranked = rows.withColumn("_order", order[F.col("tier")])
    lead = ranked.groupBy("doc_id").agg(F.min("_order").alias("_lead"))
    wide = (
        ranked.groupBy("doc_id", "sn")
        .agg(
            F.min_by("description", "_order").alias("description"),
            F.min("_order").alias("_first"),
            *[
                F.max(F.when(F.col("tier") == t, F.col(c))).alias(f"{t}_{c}")
                for t in rules.TIERS
                for c in columns
            ],
        )
    )
    return wide.join(lead, "doc_id").where("_first = _lead").drop("_first", "_lead")


def offer(rows, wide=False):
    """Offer columns with defaults; ``wide`` adds brand and model."""
    product = money(number_in(rows, "qty") * number_in(rows, "rate"))
    amount = F.coalesce(number_in(rows, "amount"), product, F.lit(0).cast("decimal(18,2)"))
    head = [
        *[c for c in ("doc_id", "tier") if c in rows.columns],
        "sn",
        or_else("brand_image", F.col("image_ref") if wide else F.lit(None).cast("string")).alias("image"),
        or_else("brand_desc", "description", F.lit("N/A")).alias("description"),
    ]
    if wide:
        head += [F.coalesce(c, F.lit("")).alias(c.replace("selected_", "")) for c in ("selected_brand", "selected_model")]
    return rows.select(
        *head,
        or_else(F.col("qty").cast("string"), F.lit("0")).alias("qty"),
        or_else("unit", F.lit("Nos")).alias("unit"),
        or_else(F.col("rate").cast("string"), F.lit("0")).alias("rate"),
        money(amount).alias("amount"),
    )
