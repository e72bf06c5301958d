"""Per-key results over keys of very uneven frequency.

Every result here is algebraic: a task folds its rows into a hash table of
key states (which spills when full), and only one compact state per key and
task is shuffled.  A key that holds a third of all rows therefore costs each
reducer one row per upstream task, not its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    """``(key_value, n_rows)`` of every non-null key."""
    return df.select(key.alias("key_value")).where(F.col("key_value").isNotNull()).groupBy("key_value").agg(F.count("*").alias("n_rows"))


def heavy_keys(df: DataFrame, keys: dict[str, Column], share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows of ``df``: ``(key_column, key_value, n_rows)``.

    Null keys are rows of the total but never keys.  An empty table has no
    heavy keys; repeated rows count as often as they occur.  Extra columns
    are ignored (each key is projected before anything moves).
    """
    total = df.agg(F.count("*").alias("total_rows"))
    parts = []
    for name, key in keys.items():
        counted = key_counts(df, key)
        parts.append(counted.select(F.lit(name).alias("key_column"), F.col("key_value").cast("string").alias("key_value"), "n_rows"))
    counts = reduce(DataFrame.unionByName, parts)
    # the total is one row, a scalar by construction
    return counts.join(F.broadcast(total), F.col("n_rows") >= F.lit(share) * F.col("total_rows")).drop("total_rows")


def key_profile(df: DataFrame, key: Column, member: Column, position: Column, key_name: str) -> DataFrame:
    """Rows, distinct members and position range of each key.

    The distinct count goes through ``(key, member)`` states first, so that a
    hot key's members are spread over all reducers before they are counted.
    Null keys form no group, null members count as rows but not as members.
    """
    rows = df.select(key.alias(key_name), member.alias("_member"), position.alias("_pos")).where(F.col(key_name).isNotNull())
    inner = rows.groupBy(key_name, "_member").agg(F.count("*").alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
    return inner.groupBy(key_name).agg(
        F.sum("_n").cast("bigint").alias("n_rows"), F.count("_member").alias("n_members"), F.min("_lo").alias("min_pos"), F.max("_hi").alias("max_pos")
    )
