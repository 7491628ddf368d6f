"""Running totals over a whole table without bringing it to one task.

The rows are dealt by ranges of the order's quantiles; each range has its own
running total, and starts from the sum of the ranges before it: two passes, and
nothing but a row a range on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order: str, totals: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Adds, for each (name, column), the sum of the column over all rows up to this one in ``order``, which no two rows share.

    ``df`` is read three times: hand in a table that is cheap to read. Null in
    ``order`` comes first; null values count as 0.
    """
    ranges = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
    kind = dict(df.dtypes)[order]
    bounds = F.array(*(F.lit(b).cast(kind) for b in sorted(set(found or []))))
    dealt = df.withColumn("__range", F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(order))), F.lit(0)) if found else F.lit(0))
    sums = dealt.groupBy("__range").agg(*(F.sum(c).alias(name) for name, c in totals.items())).collect()  # a row a range
    before: dict[str, list] = {name: [] for name in totals}
    for name in totals:
        held = {r["__range"]: r[name] or 0 for r in sums}
        at = 0
        for k in range(len(set(found or [])) + 1):
            before[name].append(at)
            at += held.get(k, 0)
    own = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = lambda name: F.get(F.array(*map(F.lit, before[name])), F.col("__range"))
    return dealt.withColumns({name: F.coalesce(F.sum(c).over(own), F.lit(0)) + start(name) for name, c in totals.items()}).drop("__range")
