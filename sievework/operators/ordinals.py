"""Row numbers within a key, however many of all rows the key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.shared import materialise, unused

#: monotonically_increasing_id() has the partition above these bits and the place in it below.
PLACE_BITS = 33


def dealt(rows: DataFrame, keys: list[str], order: list[str | Column], at: str) -> DataFrame:
    """The rows dealt by ranges of (keys, order) and sorted in each, with their place `at`, written to the shared folder.

    A key's rows lie in as many ranges as their share asks for, one after another.
    """
    by = [*map(F.col, keys), *(F.col(x) if isinstance(x, str) else x for x in order)]
    return materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "dealt")


def ordinals(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "nth") -> DataFrame:
    """The rows with `name`: their number, from 1 and without gaps, among those that agree in keys (null is a key), in this order.

    A prefix sum in two passes: rows are dealt by ranges of (keys, order) and numbered within each range; then each range and
    key gets the count of that key's rows in the ranges before. No task holds a whole key; what the second pass sums has a row
    a range and key. Without keys all rows are numbered. Rows that agree in keys and order are numbered as they come, and
    share a range: give an order that tells rows apart.
    """
    at, part, first, size, before = unused([*rows.columns, name], "at_", "part_", "first_", "size_", "before_")
    own = dealt(rows, keys, order, at).withColumn(part, F.shiftright(at, PLACE_BITS))
    runs = own.groupBy(part, *keys).agg(F.min(at).alias(first), F.count("*").alias(size))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {k: f"{before}{k}" for k in keys}
    offsets = runs.select(F.col(part).alias(size), *(F.col(k).alias(v) for k, v in renamed.items()), first, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    same = [own[part] == offsets[size], *(own[k].eqNullSafe(offsets[v]) for k, v in renamed.items())]
    nth = F.col(before) + F.col(at) - F.col(first) + 1
    return own.join(offsets, reduce(Column.__and__, same)).select(*(own[c] for c in rows.columns), nth.alias(name))
