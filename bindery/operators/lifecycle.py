"""Listing lifecycle: what a sequence of observations leaves in the active and sold projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.offers import RESALE_KINDS


def fold(df: DataFrame, key: str, arrival: list) -> DataFrame:
    """One row of each key after all observations, in order of arrival (which counts even against event time).

    df: key, status, format, kind, observed_at, price_minor, and the `arrival` columns. `active_at` is set by the first
    active observation and kept; an observation that isn't active makes an existing active row inactive; a physical
    completed one of a resale source makes a sold row, which later activity leaves alone; exclusion or a digital
    observation excludes it.
    """
    known = F.col("format").isin("physical", "digital") & F.col("kind").isNotNull()
    on = (F.col("status") == "active") & known
    sale = (F.col("status") == "completed") & (F.col("format") == "physical") & F.col("kind").isin(*RESALE_KINDS)
    off = (F.col("status") == "excluded") | (F.col("format") == "digital")
    # One window numbers the arrivals; all else are partial sums over these numbers.
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*arrival)))
    at = lambda c: F.when(c, F.col("_n"))
    df = df.groupBy(key).agg(
        F.max("_n").alias("observations"), F.min(at(on)).alias("_first_on"), F.max(at(on)).alias("_last_on"), F.max(at(sale)).alias("_last_sale"), F.max(at(off)).alias("_last_off"),
        F.max(at(~on)).alias("_last_other"), F.max_by(F.struct("observed_at", "price_minor"), at(on)).alias("_on"), F.max_by(F.struct("observed_at", "status"), at(~on)).alias("_other"),
        F.min_by("observed_at", at(on & F.col("observed_at").isNotNull())).alias("active_at"), F.max_by(F.struct("observed_at", "price_minor"), at(sale)).alias("_sale"),
    )
    df = df.withColumn("_after", F.when(F.col("_last_other") > F.col("_first_on"), F.col("_other")))
    active = F.col("_last_on") == F.col("observations")
    return df.select(
        key, "observations", active.alias("is_active"), "active_at", F.col("_on.price_minor").alias("asking_minor"),
        F.when(~active, F.col("_after.observed_at")).alias("inactive_at"), F.when(~active, F.col("_after.status")).alias("inactive_reason"),
        F.col("_sale.observed_at").alias("sold_at"), F.col("_sale.price_minor").alias("sold_minor"),
        F.when(F.col("_last_sale").isNotNull(), F.when(F.col("_last_off") > F.col("_last_sale"), "excluded").otherwise("linked")).alias("sold_review"),
    )


def transitions(df: DataFrame, key: str, arrival: list) -> DataFrame:
    """Rows at which the status differs from the key's previous one, with that one."""
    w = Window.partitionBy(key).orderBy(*arrival)
    return df.withColumn("previous", F.lag("status").over(w)).where("previous IS NULL OR previous <> status")


def streaks(df: DataFrame, key: str, order: list, hit) -> DataFrame:
    """Rows without a hit since the last one, as of each row: gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_island", F.sum(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(key, "_island").orderBy(*order)
    return df.withColumn("streak", F.sum(F.when(hit, 0).otherwise(1)).over(v.rowsBetween(Window.unboundedPreceding, 0))).drop("_island")
