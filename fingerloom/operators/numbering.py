"""Numbers from 1 and running totals over an order of all rows, without bringing them into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fingerloom.sources.staging import staged

_INDEX_BITS = 33  # of monotonically_increasing_id that count within a partition


def _placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows dealt out by ranges of `order`, sorted there and staged with __part and __place, their number in it from 0."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    kept = staged(placed, "numbered").withColumn("__part", F.shiftright("__id", _INDEX_BITS))
    return kept.withColumn("__place", F.col("__id") - F.shiftleft("__part", _INDEX_BITS)).drop("__id")


def _before(totals: dict[int, int]) -> Column:
    """For each part the sum of the earlier parts' totals, one figure for each partition."""
    firsts = list(accumulate([0, *[totals.get(k, 0) for k in range(max(totals, default=0))]]))
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in firsts]), (F.col("__part") + 1).cast("int"))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds a long column of row numbers by `order`, which must tell all rows apart."""
    kept = _placed(df, *order)
    sizes = dict(kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
    return kept.withColumn(name, (_before(sizes) + F.col("__place") + 1).cast("long")).drop("__place", "__part")


def running(df: DataFrame, number: str, total: str, value: str, *order: Column | str) -> DataFrame:
    """As numbered, and the sum of `value` over all earlier rows; nulls count as 0."""
    kept = _placed(df, *order)
    found = kept.groupBy("__part").agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("v")).collect()
    within = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long")
    counted = kept.withColumn(total, _before({r["__part"]: r.v for r in found}) + here)
    return counted.withColumn(number, (_before({r["__part"]: r.n for r in found}) + F.col("__place") + 1).cast("long")).drop("__place", "__part")
