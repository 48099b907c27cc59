"""Running values over long sequences, in two levels: inside ranges of the order, then over one row a range.

A window over a whole sequence sorts it in one task. Here the ranges are what windows work on, and only each range's last row and total
go on to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, keys: list[str], part: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds a column for each of `values`: what it is in the row before, by `order` within `keys`; null in the first row.

    `part` numbers the ranges: it never falls along the order.
    """
    cut = rows.withColumns({"_part": part, "_now": F.struct(*[v.alias(k) for k, v in values.items()])})
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    ends = cut.groupBy(*keys, "_part").agg(F.max_by("_now", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_end"))
    before = ends.select(*keys, "_part", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part")).alias("_end"))
    found = cut.withColumn("_own", F.lag("_now").over(inside)).join(before, [*keys, "_part"])
    whole = F.coalesce("_own", "_end")
    return found.withColumns({k: whole[k] for k in values}).drop("_part", "_now", "_own", "_end")


def counted(rows: DataFrame, keys: list[str], part: Column, order: list[Column], flag: Column, name: str) -> DataFrame:
    """Adds a running sum (long) of `flag` (0 or 1), the row's own included, by `order` within `keys`; `part` as in carried()."""
    cut = rows.withColumns({"_part": part, "_flag": flag.cast("bigint")})
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_part").agg(F.sum("_flag").alias("_all"))
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_before"))
    found = cut.withColumn("_own", F.sum("_flag").over(inside)).join(before, [*keys, "_part"])
    return found.withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_flag", "_own", "_before")
