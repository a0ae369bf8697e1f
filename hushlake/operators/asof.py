"""As-of join: each row with the latest row of another table before it, range by range, the last rows carried over edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time that a key is cut into, at most: one key with most of the rows still spreads over so many tasks.
RANGES = 64


def _ranges(rows: DataFrame, time: str, ranges: int) -> list:
    """Edges between ranges of about equally many rows, from one pass with a sketch."""
    if ranges < 2:
        return []
    found = rows.agg(F.percentile_approx(time, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("e")).first()["e"]
    return sorted(set(found or ()))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, ranges: int = RANGES, within: Column | None = None, strict: bool = False, keep: bool = True) -> DataFrame:
    """left's rows, each with r: the struct of right's columns in the row of equal by with the largest time up to its own (before
    it, if strict); null without one. Rows of right with the same time go by the order of their columns, the last one counts.

    within is a condition on time and r.time that a row has to meet as well, such as an age; a match that doesn't is
    none. Unless keep, rows without a match go. A null in by or time matches nothing. An empty right matches nothing.

    Both tables are cut into ranges of time of about equal size. The last right row of each key and range is a small
    table, in which a window finds what every range starts from; then each range of each key is a sorted run by itself.
    Two shuffles, one of them of that small table; no key is larger than a range in any task.
    """
    edges = _ranges(left.select(time).unionByName(right.select(time)), time, ranges)
    where = reduce(lambda a, b: a + b, [F.when(F.col(time) >= F.lit(e), 1).otherwise(0) for e in edges], F.lit(0)).alias("__range")
    whole = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, time]))
    r = right.filter(whole).select(*by, where, F.col(time).alias("__t"), F.struct(*right.columns).alias("__r"))
    l = left.filter(whole).select(*by, where, F.col(time).alias("__t"), F.struct(*left.columns).alias("__l"))
    place = [*by, "__range"]
    last = r.groupBy(*place).agg(F.max(F.struct("__t", "__r")).alias("__last"))
    some = l.select(*place).distinct().join(last, place, "full")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = some.select(*place, F.last("__last", ignorenulls=True).over(before).alias("c")).filter("c IS NOT NULL").select(*place, F.col("c.__t").alias("__t"), F.col("c.__r").alias("__r"))
    # at one time the carried row comes first, then right's rows, then left's; for a strict match left's come before
    rows = carried.withColumn("__o", F.lit(0)).unionByName(r.withColumn("__o", F.lit(2))).unionByName(l.withColumn("__o", F.lit(1 if strict else 3)), allowMissingColumns=True)
    run = Window.partitionBy(*place).orderBy("__t", "__o", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__m", F.last("__r", ignorenulls=True).over(run)).filter("__l IS NOT NULL").select("__l.*", F.col("__m").alias("r"))
    if within is not None:
        found = found.withColumn("r", F.when(within, F.col("r")))
    if not keep:
        return found.filter("r IS NOT NULL")
    return found.unionByName(left.filter(~F.coalesce(whole, F.lit(False))).withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))
