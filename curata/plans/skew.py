"""Joins against dictionaries whose keys may be very unequal in frequency.

A key that holds a third of all rows would put a third of the left side into one task of a shuffled join.
Keys seen at least ``rows / HOT_SHARE`` times number at most ``HOT_SHARE`` (each takes that many rows), so the
dictionary entries of the hot keys have a proven size bound and may be broadcast; all others are joined by a
shuffle in which no key holds more than ``rows / HOT_SHARE`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can be hot.
HOT_SHARE = 2000


def hot_limit(rows: int) -> int:
    """The count from which a key is hot, given the number of left rows."""
    return max(1000, -(-rows // HOT_SHARE))


def dictionary_join(left: DataFrame, entries: DataFrame, keys: list[str], freq: str, limit: int) -> DataFrame:
    """Inner join of ``left`` with ``entries`` (unique on ``keys``), hot entries by broadcast.

    ``freq`` is the column of ``entries`` with the number of left rows of the key; it is dropped.
    ``limit`` comes from :func:`hot_limit`. NULL keys match nothing, as in SQL.
    """
    mark = "__hot"
    hot = entries.where(F.col(freq) >= limit).drop(freq)
    cold = entries.where(F.col(freq) < limit).drop(freq)
    payload = [c for c in hot.columns if c not in keys]
    probe = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), keys, "left")
    by_broadcast = probe.where(F.col(mark)).drop(mark)
    rest = probe.where(F.col(mark).isNull()).drop(mark, *payload)
    return by_broadcast.unionByName(rest.join(cold, keys, "inner"))

