"""Collects queries and their oracle SQL."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = {}
ORACLES = {}


def plain(df):
    """Decimals as doubles, so both engines return the same Python type."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
