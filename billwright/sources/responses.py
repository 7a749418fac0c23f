"""Stored model responses to rows.

The text around the JSON is cut away and the JSON parsed with expressions. Only responses that do
not parse go through the Arrow-batched repair; what still does not parse is a reject.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from billwright.operators.settle import settle

ITEM = (
    "struct<sn:string,location:string,scope:string,code:string,description:string,"
    "qty:string,unit:string,rate:string,amount:string,hasImage:boolean>"
)
_CONTROL = "[\\x00-\\x1F\\x7F-\\x9F]"


def with_json_text(responses):
    """Adds ``block`` and ``rows_text``.

    ``block`` runs from {"items" or {"inventory" or the first brace to the last brace, else it is the
    text without code fences. ``rows_text`` is the smallest part with a "rows" list, when its braces
    balance. Each search is a column of its own so that it is evaluated once.
    """
    raw = F.col("raw")
    searched = responses.select(
        "response_id",
        "raw",
        F.regexp_extract(raw, r'(?s)(\{\s*"(?:items|inventory)"\s*:.*\})', 1).alias("_anchored"),
        F.regexp_extract(raw, r"(?s)(\{.*\})", 1).alias("_braced"),
        F.regexp_extract(raw, r'(?s)(\{.*?"rows".*?\[.*?\].*?\})', 1).alias("_rows"),
    )
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```$", ""))
    balanced = F.length(F.regexp_replace("_rows", r"[^{]", "")) == F.length(F.regexp_replace("_rows", r"[^}]", ""))
    clean = lambda c: F.regexp_replace(c, _CONTROL, "")
    return searched.select(
        "response_id",
        "raw",
        clean(F.coalesce(F.nullif("_anchored", F.lit("")), F.nullif("_braced", F.lit("")), bare)).alias("block"),
        F.when((F.col("_rows") != "") & balanced, clean(F.col("_rows"))).alias("rows_text"),
    )


def _balance(text):
    """Close an odd quote and every open bracket."""
    text = text + '"' if text.count('"') % 2 else text
    pairs, open_ones = {"{": "}", "[": "]"}, []
    for char in text:
        if char in pairs:
            open_ones.append(pairs[char])
        elif open_ones and char == open_ones[-1]:
            open_ones.pop()
    return text + "".join(reversed(open_ones))


@F.pandas_udf(StringType())
def repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _balance(t))


def _valid(text):
    return F.when(F.try_parse_json(text).isNotNull(), text)


def parse_responses(responses):
    """(rows, rejects). Rows carry response_id, pos and the item fields; rejects keep the raw text."""
    doc = F.coalesce(_valid(F.col("rows_text")), _valid(F.col("block")))
    first = settle(with_json_text(responses).select("response_id", "raw", "block", doc.alias("doc")), "responses")
    good = first.where("doc is not null")
    mended = first.where("doc is null").withColumn("doc", _valid(repair("block")))
    parsed = good.unionByName(mended.where("doc is not null"))
    names = ("rows", "items", "inventory")
    lists = F.coalesce(*[F.from_json(F.get_json_object("doc", f"$.{n}"), f"array<{ITEM}>") for n in names])
    rows = parsed.select("response_id", F.posexplode(lists).alias("pos", "item")).select("response_id", "pos", "item.*")
    rejects = mended.where("doc is null").select("response_id", "raw")
    return rows, rejects
