"""Joins of many rows to one row per key, whatever the share of a single key.

Adaptive execution splits a hot key only when both sides come straight out of
a shuffle. Where the unique side is an aggregate or a join, the rows of hot
keys stay where they are and get their few unique rows by broadcast; all other
rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.roles import quoted

HOT = 10_000  # a key is hot with more than 1 / HOT of all rows: fewer than HOT keys are


def attach(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``unique``, which has one narrow row per ``key``.

    A count per key, which tasks combine before the shuffle, tells whether any is
    hot; usually none is and this is a plain join. There are fewer than HOT hot keys, so the broadcasts are bounded.
    Rows of a hot key are never moved, be they copies of each other or not, and
    neither are rows without a key, which match nothing.
    """
    counts = rows.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("_n"))
    whole, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not whole or most * HOT <= whole:
        return rows.join(unique, key, how)
    hot = F.broadcast(counts.filter(quoted(key).isNotNull() & (F.col("_n") * HOT > whole)).select(quoted(key)))
    staying = rows.join(hot, key, "left_semi")
    if how == "left":
        staying = staying.unionByName(rows.filter(quoted(key).isNull()))
    moving = rows.filter(quoted(key).isNotNull()).join(hot, key, "left_anti")
    copied = F.broadcast(unique.join(hot, key, "left_semi"))
    return staying.join(copied, key, how).unionByName(moving.join(unique, key, how))
