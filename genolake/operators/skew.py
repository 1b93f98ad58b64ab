"""Handing results per key back to rows when one key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolake.session import partitions


def hand_back(rows: DataFrame, found: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``found``, which has one row per key and, as ``size``, the number of rows that hold it.

    A key with more than a share of 1 / (4 * partitions) of the rows is hot. There are fewer than four times as many hot keys as
    partitions, whatever the data, so they are broadcast; all other keys meet in a shuffle. ``rows`` is read twice.
    """
    total = found.agg(F.sum(size)).first()[0] or 0
    parts = 4 * partitions(rows.sparkSession)
    is_hot = F.col(size).cast("decimal(38,0)") * parts > F.lit(total)
    hot, cold = found.filter(is_hot).drop(size), found.filter(~is_hot).drop(size)
    spread = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(spread)
