"""Blocked numbering must equal a plain window, also when every key counts as hot."""

import os
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from billwright.operators.ordering import number_rows, previous, running_sum
from billwright.streaming.jobs import session_gaps


SF = "/root/testdata/sf0.001"


def frame(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randint(0, 5)) for i in range(400)]
    return spark.createDataFrame(rows, "k int, o int, v int")


def scans(df, name):
    """How often the plan that ran reads the table."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(name in line and "Scan" in line for line in text.splitlines())


def test_blocks_equal_window(spark):
    df, w = frame(spark), Window.partitionBy("k").orderBy("o")
    for block in (F.lit(0), F.floor(F.col("o") / 16), F.when(F.col("o") > 30, F.floor(F.col("o") / 16))):
        got = number_rows(df, ["k"], ["o"], "n", block).select("k", "o", "n")
        want = df.select("k", "o", F.row_number().over(w).alias("n"))
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
        got = running_sum(df, ["k"], ["o"], F.col("v"), "s", block).select("k", "o", "s")
        want = df.select("k", "o", F.sum("v").over(w).alias("s"))
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
        got = previous(df, ["k"], ["o"], F.col("o"), "p", block).select("k", "o", F.coalesce("p", F.lit(-1)))
        want = df.select("k", "o", F.coalesce(F.lag("o").over(w), F.lit(-1)))
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("query, table", [("row_edits", "lineitem"), ("session_expiry", "events"), ("hardening_upsert", "part"), ("extracted_shape", "lineitem"), ("image_cursor", "documents"), ("tier_comparison", "lineitem"), ("image_pairs", "documents")])
def test_base_table_is_read_at_most_twice(spark, query, table):
    import __spark_entry__ as entry

    assert scans(entry.queries()[query](spark, SF), f"{table}.parquet") <= 2


def test_sessions_cut_by_day(spark):
    rng = random.Random(3)
    rows = [(str(rng.choice([1, 1, 2])), 1_700_000_000 + rng.randint(0, 5 * 86400), i) for i in range(300)]
    events = spark.createDataFrame(rows, "session_id string, s long, event_id long").select(
        "session_id", F.timestamp_seconds("s").alias("ts"), "event_id"
    )
    plain = session_gaps(events, block=F.lit(0)).select("event_id", "session_no").collect()
    cut = session_gaps(events).select("event_id", "session_no").collect()
    assert sorted(plain) == sorted(cut)
    assert max(r["session_no"] for r in plain) > 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_totals_number_no_lines(spark):
    """Totals need no line numbers: no offsets of blocks are written and joined for them."""
    import __spark_entry__ as entry

    plan = entry.queries()["plan_totals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_nb_block" not in plan and "_offset" not in plan
