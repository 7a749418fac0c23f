"""Joins on 'one text contains the other' without comparing every pair.

A text is contained in another when it equals one of its substrings. Cutting one side into its
substrings turns containment into an equality join, which emits true matches only. The catalog
side of each join is pre-aggregated to what the caller needs (a best product per key), so a name
that matches a large share of the catalog costs one row, not one row per product. Substrings are
cut only at the lengths that occur on the other side of the same brand.
"""

from pyspark.sql import functions as F


def lengths(df, group, key, out):
    """Distinct key lengths per group: as many entries as there are lengths."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(F.length(key))).alias(out))


def cut(key, wanted):
    """Distinct substrings of the key at the wanted lengths; length 0 gives ''."""
    key, wanted = F.col(key), F.col(wanted)
    usable = F.filter(wanted, lambda n: n <= F.length(key))
    pieces = F.transform(
        usable,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: key.substr(i, n)),
    )
    return F.array_distinct(F.flatten(pieces))


def inside(targets, catalog, group="brand_id"):
    """Catalog keys contained in a target key (equality included)."""
    cuts = (
        targets.select(group, "t_key")
        .join(lengths(catalog, group, "p_key", "_lengths"), group)
        .select(group, "t_key", F.explode(cut("t_key", "_lengths")).alias("p_key"))
    )
    return cuts.join(catalog, [group, "p_key"])


def around(targets, catalog, group="brand_id"):
    """Catalog keys that contain a target key (equality included).

    The catalog keys are reduced to distinct texts before they are cut, and cut texts that are no
    target are dropped before the catalog columns join back.
    """
    keys = targets.select(group, "t_key").distinct()
    cuts = (
        catalog.select(group, "p_key").distinct()
        .join(lengths(keys, group, "t_key", "_lengths"), group)
        .select(group, "p_key", F.explode(cut("p_key", "_lengths")).alias("t_key"))
        .join(keys, [group, "t_key"], "left_semi")
    )
    return cuts.join(catalog, [group, "p_key"])
