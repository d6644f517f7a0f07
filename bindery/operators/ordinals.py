"""Numbers and running sums through a whole table, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.storage import Scratch


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each one, in a total `order`.

    Rows are dealt out by ranges and stored, so ranges keep their rows; each range sums its own, and only the ranges'
    totals, one row for each, are summed in one task.
    """
    dealt = Scratch(df.sparkSession).put(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    total = dealt.groupBy("_range").agg(F.sum(value).alias("_n"))
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_range", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(total), "_range").withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(own), F.lit(0))).cast("long"))
    return out.drop("_range", "_base")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with each row's number, from 1, in a total `order`."""
    return running(df.withColumn("_one", F.lit(1)), order, "_one", name).withColumn(name, F.col(name) + 1).drop("_one")
