"""Joins and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SALTS = 16


def lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join on keys unique in `small`; rows of a hot key spread over `salts` partitions, for which `small` is repeated."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # merged, never broadcast: the repeated table is `salts` times as large as its statistics say
    return left.join(right.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before each one, in `order`, within its group.

    The rows are range-partitioned by (groups, order) and saved, so a group spreads over as many partitions as it needs.
    Only one row for each partition and group is gathered to carry sums from partition to partition.
    `order` must be unique within a group.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*groups, *order]
    parts = scratch.saved(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), name)
    totals = parts.groupBy("__part", *groups).agg(F.sum(value).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = totals.withColumn("__before", before).drop("__total")
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # `carried` has a row for each partition and for each group's first partition: (partitions + groups) rows.
    return parts.join(carried, ["__part", *groups]).withColumn(out, (F.col("__before") + within).cast("long")).drop("__part", "__before")
