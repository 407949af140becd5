"""Numbers of rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, MOST_RANGES = 1_000_000, 512


def numbered(rows: DataFrame, key: Column, name: str = "line_no", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their place, from 1, in the order of `key`, which tells all rows apart.

    A sample of the keys cuts the order into ranges of about range_rows, MOST_RANGES at most; a range's rows are numbered in one task and
    the counts of the ranges before are added. Only cuts and counts come to the driver. The cuts are taken once, so they tell nothing but how even
    the ranges are. Null keys come first; rows of one key are in any order.
    """
    keyed = rows.withColumn("_key", key)
    total = keyed.count()
    ranges = min(MOST_RANGES, -(-total // range_rows))
    cuts: list = []
    if ranges > 1:
        seen = sorted(r["_key"] for r in keyed.select("_key").where("_key is not null").sample(min(1.0, 32 * ranges / total), seed=7).collect())
        cuts = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    if not cuts:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key"))  # one range of a bounded number of rows
        return keyed.withColumn(name, place.cast("long")).drop("_key")
    own = keyed.withColumn("_range", F.coalesce(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_key"))), F.lit(0)))
    counts = {r["_range"]: r["count"] for r in own.groupBy("_range").count().collect()}
    before = [sum(counts.get(k, 0) for k in range(n)) for n in range(len(cuts) + 1)]
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return own.withColumn(name, place + F.element_at(F.lit(before).cast("array<long>"), F.col("_range") + 1)).drop("_key", "_range")
