"""Points within spans of time, joined on equal keys and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each level's buckets are so many times as long as those of the level below.
STEP = 8
LEVELS = 8


def merged(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of each key's spans [start, end) as spans that neither overlap nor touch; a null end is open. Gaps and islands;
    spans of one start are one row before they are sorted."""
    one = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    one = one.groupBy(*keys, start).agg(F.when(F.count_if(F.col(end).isNull()) == 0, F.max(end)).alias(end))
    w = Window.partitionBy(*keys).orderBy(start)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.max(F.col(end).isNull()).over(before), F.lit(False))
    new = F.when(open_ | (F.max(end).over(before) >= F.col(start)), 0).otherwise(1)
    island = one.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.when(F.count_if(F.col(end).isNull()) == 0, F.max(end)).alias(end)).drop("_island")


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 86_400, how: str = "inner") -> DataFrame:
    """Rows of `points` with those of `spans` that have equal `keys` and start <= at < end; a null end is open. `how`: inner, left_semi or left_anti.

    A span belongs to the lowest level whose buckets are as long as it, so it lies in two buckets at most; a point lies in one
    bucket of each level that any span has. Neither long spans nor long times make more rows, and keys with many spans are cut by time. Open
    spans, and those beyond the top level, stand in a bucket of their own. `width`: seconds of the lowest buckets.
    """
    length = _seconds(end) - _seconds(start)
    sizes = [width * STEP**i for i in range(LEVELS)]
    level = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        level = F.when(length <= sizes[i], i).otherwise(level)
    size = F.element_at(F.array(*(F.lit(s).cast("long") for s in sizes), F.lit(1).cast("long")), F.col("_level") + 1)
    bucket = lambda t: F.when(F.col("_level") < LEVELS, F.floor(t / size)).otherwise(0)
    last = F.coalesce(_seconds(end), _seconds(start))
    s = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end)))).withColumn("_level", level)
    s = s.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(_seconds(start)), bucket(last)))))
    used = sorted(r[0] for r in s.select("_level").distinct().collect())  # LEVELS + 1 at most: points go to these only
    p = points.withColumn("_level", F.explode(F.expr(f"cast(array({', '.join(map(str, used))}) as array<int>)"))).withColumn("_bucket", bucket(_seconds(at)))
    both = [*keys, "_level", "_bucket"]
    within = (F.col(f"p.{at}") >= F.col(f"s.{start}")) & (F.col(f"s.{end}").isNull() | (F.col(f"p.{at}") < F.col(f"s.{end}")))
    equal = within
    for k in both:
        equal = equal & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    if how == "inner":
        rest = [F.col(f"s.{c}") for c in spans.columns if c not in keys]
        return p.alias("p").join(s.alias("s"), equal).select(*(F.col(f"p.{c}") for c in points.columns), *rest)
    found = p.alias("p").join(s.alias("s"), equal, "left_semi").select(*points.columns).distinct()
    if how == "left_semi":
        return found
    null_safe = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in points.columns]
    return points.distinct().alias("p").join(found.alias("f"), null_safe, "left_anti")
