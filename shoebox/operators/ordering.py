"""Order over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def running_totals(rows: DataFrame, bucket: Column, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds running sums in the order of (bucket, order): each bucket is summed, the few sums are accumulated over
    buckets, and the rows of a bucket start from what the buckets before it add up to. bucket must not
    decrease along the order, and null comes first."""
    tagged = rows.withColumn("_bucket", bucket)
    sums = tagged.groupBy("_bucket").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()))
    before = W.Window.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sums.select(F.col("_bucket").alias("_of"), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in totals))
    here = W.Window.partitionBy("_bucket").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    joined = tagged.join(bases, tagged["_bucket"].eqNullSafe(bases["_of"]))
    for n, c in totals.items():
        joined = joined.withColumn(n, F.col(f"_base_{n}") + F.sum(c).over(here))
    return joined.drop("_bucket", "_of", *(f"_base_{n}" for n in totals))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first rows of each group; Spark cuts groups to `most` before it shuffles them."""
    place = F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, place).filter(F.col(name) <= most)
