"""Running sums and places in a global order, by ranges: no task sees all rows.

Rows are dealt out by range and written, so that both passes see the same ranges. A small window over
one row for each range gives what comes before it; the rest is a window inside the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simgate.sources.shared import kept


def running(rows: DataFrame, order: dict[str, Column], sums: dict[str, Column], following: str | None = None) -> DataFrame:
    """rows with the running sums (this row's included), by name, in an order whose keys have names and tell rows apart.

    ``following``: also ``next_<name>``, the value that this column has in the next row.
    """
    keys = {f"order_{name}": c for name, c in order.items()}
    plus = {f"sum_{name}": c for name, c in sums.items()}
    ranged = rows.withColumns(keys | plus).repartitionByRange(*keys).withColumn("range", F.spark_partition_id())
    ranged = kept(ranged, "ranges")
    first = [F.min_by(following, F.struct(*keys)).alias("first")] if following else []
    each = ranged.groupBy("range").agg(*(F.sum(c).alias(c) for c in plus), *first)  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = {f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in plus}
    starts |= {"after": F.lead("first").over(Window.orderBy("range"))} if following else {}
    inside = Window.partitionBy("range").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = ranged.join(F.broadcast(each.select("range", *(c.alias(n) for n, c in starts.items()))), "range")
    out = {name: F.col(f"before_sum_{name}") + F.sum(f"sum_{name}").over(upto) for name in sums}
    if following:
        out[f"next_{following}"] = F.coalesce(F.lead(following).over(inside), F.col("after"))
    return got.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def placed(rows: DataFrame, order: dict[str, Column], name: str) -> DataFrame:
    """rows with their place, from 1, in a global order."""
    return running(rows, order, {name: F.lit(1).cast("long")})


def running_within(rows: DataFrame, by: list[str], order: dict[str, Column], weight: Column, name: str) -> DataFrame:
    """rows with the running sum of a weight (this row's included) in their group, and the group's sum, ``n``; one group may hold most rows.

    Groups lie one after another, so a range and a group meet about as often as there are ranges and groups.
    """
    keys = {f"order_by_{i}": F.col(c) for i, c in enumerate(by)} | {f"order_{n}": c for n, c in order.items()}
    ranged = kept(rows.withColumns(keys | {"own_weight": weight}).repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    of = [f"of_{i}" for i in range(len(by))]
    each = ranged.groupBy(F.col("range").alias("at"), *(F.col(c).alias(o) for c, o in zip(by, of, strict=True))).agg(F.sum("own_weight").alias("own"))
    one = Window.partitionBy(*of)
    before = F.sum("own").over(one.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select("at", *of, F.coalesce(before, F.lit(0)).alias("start"), F.sum("own").over(one).alias("n"))
    meet = F.col("range") == F.col("at")
    for c, o in zip(by, of, strict=True):
        meet = meet & F.col(c).eqNullSafe(F.col(o))
    got = ranged.join(F.broadcast(starts), meet)
    inside = F.sum("own_weight").over(Window.partitionBy("range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return got.select(*rows.columns, (F.col("start") + inside).alias(name), "n")


def placed_within(rows: DataFrame, group: str, order: dict[str, Column], name: str) -> DataFrame:
    """rows with their place, from 1, in their group, and the group's size, ``n``."""
    return running_within(rows, [group], order, F.lit(1).cast("long"), name)
