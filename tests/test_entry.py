"""A few registered queries against their SQL on the smallest tables; tools/check_oracle.py runs all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
NAMES = ["costed_totals", "boq_pivot", "fuzzy_model_match", "dedup_priority", "session_expiry", "page_links", "tier_comparison", "link_caps", "hardening_upsert", "dedupe_match_broadcast", "row_edits",
         "line_clusters", "image_pairs", "image_by_line", "crop_bands", "source_merge", "catalog_upsert", "fitout_outcome", "rate_card_match", "brand_scan", "brand_scan_tier", "catalog_write", "cell_scan",
         "page_cards", "page_blocks", "harvest_site_products", "extracted_summary", "sheet_stitch", "session_expiry_stream", "first_discoveries_stream"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import __spark_entry__ as entry
    from tools.check_oracle import connect, norm

    df = entry.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    cur = connect(SF).execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want and got


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
