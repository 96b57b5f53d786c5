"""Ordered work over keys of any size, by ranges with a carried boundary.

A window partitioned by a key puts all rows of the key into one task. Here rows are dealt to ranges
of (key, order) instead, so a key with most of the rows, or one instant of it, spreads over as many
ranges as its rows need. Windows run inside a range; what a range must know of those before it is
one row per range, since only the key it begins with can have come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.session import work_dir

RANGE = "_range"


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range, ascending along `order`.

    They are written once below the shared folder: all later steps then see the same ranges, also
    where tasks run again. Equal rows may fall to either side of a boundary.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    path = work_dir(spark, "ranges")
    marked = dealt.withColumn(RANGE, F.spark_partition_id())
    marked.write.parquet(path)
    return spark.read.schema(marked.schema).parquet(path)


def with_carry(rows: DataFrame, keys: list[str], last: Column, present: Column, order: Column,
               name: str) -> DataFrame:
    """Add the last present value of a row's key in the ranges before the row's own (null without).

    The sums behind it have a row per key and range. Of these only the first key of each range can
    have a value to carry, so the joined table has at most one row per range and is broadcast.
    """
    ends = rows.groupBy(*keys, RANGE).agg(F.max_by(F.when(present, last), F.when(present, order)).alias("_last"))
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.struct(F.last("_last", ignorenulls=True).over(before).alias("value"))) \
        .filter(F.col("_carry.value").isNotNull()) \
        .select(F.col(RANGE).alias("_at"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_carry")
    same = F.col(RANGE) == F.col("_at")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return rows.join(F.broadcast(carried), same, "left").withColumn(name, F.col("_carry.value")).drop(
        "_at", "_carry", *[f"_k{i}" for i in range(len(keys))])
