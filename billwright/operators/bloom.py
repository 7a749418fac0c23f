"""Bloom filters built by an aggregate, so that large sides of set operations move only where a key may really match.

The filter is a table of 4 KB bitmaps: a key's hash names one bitmap and a few bits in it, so a test is one equality join and
the build is one aggregate with partial aggregation. False positives are settled exactly afterwards.
"""

import math

from pyspark.sql import functions as F

BITS = 32_768
PER_KEY, HASHES = 12, 4
#: Filters up to this size travel to the tested rows; larger ones meet them by shuffle.
BROADCAST_BYTES = 64 << 20


def _bits(key):
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(j)), F.lit(BITS)).cast("int") for j in range(1, HASHES + 1)])


def bloom_filter(keys, key="key"):
    """(bitmaps, filter): the filter of the values of a column, sized by their number."""
    bitmaps = max(1, math.ceil(keys.count() * PER_KEY / BITS))
    held = keys.select(F.pmod(F.xxhash64(key), F.lit(bitmaps)).alias("_bitmap"), F.explode(_bits(key)).alias("_bit"))
    return bitmaps, held.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def may_hold(rows, bloom, key="key"):
    """rows with ``_maybe``: false where the filter's table surely lacks the key."""
    bitmaps, table = bloom
    table = F.broadcast(table) if bitmaps * BITS // 8 <= BROADCAST_BYTES else table
    byte = lambda bit: F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda bit: F.expr("1") == F.call_function("getbit", byte(bit), (bit % 8).cast("int"))
    joined = rows.withColumn("_bitmap", F.pmod(F.xxhash64(key), F.lit(bitmaps))).join(table, "_bitmap", "left")
    return joined.withColumn("_maybe", F.coalesce(F.forall(_bits(key), is_set), F.lit(False))).drop("_bitmap", "_bits")
