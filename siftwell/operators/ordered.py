"""Scans along an order that need no window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, order: str, value: str, out: str, size: int = 10_000, levels: int = 4, own: bool = True) -> DataFrame:
    """Adds ``out``, the last non-null ``value`` at or before each row (before it, if not ``own``) by the whole number ``order``.

    The order is cut into ranges of ``size``. A window inside each range fills what it can; the last value of every range, a table that is
    ``size`` times smaller, is filled in the same way and carried to the rows that come before the first value of their range. ``levels``
    ranges of ranges reach ``size`` to that power, 10^16 by default; beyond, nothing is carried. Rows without an order get no carried value.
    """
    part, end, carried = f"_range{levels}", f"_end{levels}", f"_carried{levels}"
    rows = df.withColumn(part, F.floor(F.col(order) / size))
    inside = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    filled = rows.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    if levels > 1:
        ends = rows.where(F.col(part).isNotNull()).groupBy(part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(end))
        before = forward_fill(ends, part, end, carried, size, levels - 1, own=False).select(part, carried)
        filled = filled.join(before, part, "left").withColumn(out, F.coalesce(out, carried)).drop(carried)
    return filled.drop(part)
