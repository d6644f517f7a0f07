"""Upserts as folds: union, rank, keep one. Nothing is updated in place, so a failed job is simply run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in `order`, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], order: list, keep_filled: tuple[str, ...] = ()) -> DataFrame:
    """`state` with the last row in `order` of each of the batch's keys; blank `keep_filled` columns leave the old value."""
    new = keep_first(batch, keys, order)
    old = state.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in state.columns if c not in keys), F.lit(True).alias("_had"))
    joined = old.join(new.withColumn("_has", F.lit(True)), keys, "full")
    out = []
    for c in state.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        value = F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_old_{c}")) if c in keep_filled else F.col(c)
        out.append(F.when(F.col("_has"), value).otherwise(F.col(f"_old_{c}")).alias(c))
    return joined.select(*out)


def insert_absent(state: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """`state` and, of the batch, the first row of each key that it lacks. Replaying a batch changes nothing."""
    return state.unionByName(keep_first(batch, keys, order).join(state.select(*keys), keys, "left_anti"))


def pending(expected: DataFrame, checkpoint: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The expected records that the checkpoint lacks or holds with another digest."""
    return expected.join(checkpoint.select(*keys, digest), [*keys, digest], "left_anti")


def snapshots(old: DataFrame, new: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, change): added, retired, changed or kept between two snapshots."""
    a, b = old.select(key, digest.alias("_a")), new.select(key, digest.alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "retired").when(F.col("_a") != F.col("_b"), "changed").otherwise("kept")
    return a.join(b, key, "full").select(key, change.alias("change"))


def conflicts(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys with several different values, and how many."""
    return df.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("variants")).where("variants > 1")


def assert_none(violations: DataFrame, what: str) -> None:
    """Gate between stages: fails with the first violations."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")
