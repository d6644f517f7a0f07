"""Data-use grants: whether a source's reviewed permission covers what is done with its data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grant_problem(moment: Column, fields: Column, uses: Column) -> Column:
    """Reason why a grant (columns status, method, reviewed_at, effective_at, expires_at, purpose, rate, retention,
    display_mode, attribution, allowed_fields, allowed_uses) doesn't cover fields and uses at a moment, or null."""
    return (
        F.when(F.col("status") != "approved", "status")
        .when(F.coalesce("method", F.lit("")) == "", "method")
        .when(F.col("reviewed_at").isNull() | (F.col("reviewed_at") > moment), "not_reviewed")
        .when(F.col("effective_at") > moment, "not_effective")
        .when(F.col("expires_at") <= moment, "expired")
        .when(F.coalesce("purpose", F.lit("")) == "", "purpose")
        .when(F.coalesce("rate", F.lit(0)) <= 0, "rate")
        .when(F.array_contains(uses, "retain") & (F.col("retention") != "permanent"), "retention")
        .when(F.array_contains(uses, "display") & (F.coalesce("display_mode", F.lit("none")) == "none"), "display")
        .when(F.array_contains(uses, "display") & (F.coalesce("attribution", F.lit("")) == ""), "attribution")
        .when(F.size(F.array_except(fields, F.col("allowed_fields"))) > 0, "fields")
        .when(F.size(F.array_except(uses, F.col("allowed_uses"))) > 0, "uses")
    )


def observation_scope(status: Column, basis: Column, price: Column, components: Column) -> Column:
    """Which grant an observation needs: used prices, current prices or bibliography."""
    used = basis.isin("used_asking", "completed_sale") | (status == "completed") | F.exists(components, lambda x: x["basis"].isin("used_asking", "completed_sale"))
    return F.when(used, "used_prices").when(price.isNotNull() | (F.size(components) > 0), "current_prices").otherwise("bibliography")


def observation_fields(columns: dict[str, str]) -> Column:
    """Names of the fields that an observation fills, of {field: column}."""
    filled = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.lit(f)) for f, c in columns.items()]
    return F.array_sort(F.array_compact(F.array(*filled)))


def evidence_gaps(expected: DataFrame, provided: DataFrame) -> DataFrame:
    """Where the provided evidence (entity, field, url, scope) isn't the expected one: missing, extra or different."""
    e = expected.select("entity", "field", F.col("url").alias("e_url"), F.col("scope").alias("e_scope"))
    p = provided.select("entity", "field", F.col("url").alias("p_url"), F.col("scope").alias("p_scope"))
    gap = (
        F.when(F.col("p_scope").isNull(), "missing").when(F.col("e_scope").isNull(), "extra")
        .when(~F.col("e_url").eqNullSafe(F.col("p_url")), "url").when(F.col("e_scope") != F.col("p_scope"), "scope")
    )
    return e.join(p, ["entity", "field"], "full").select("entity", "field", gap.alias("gap")).where("gap IS NOT NULL")
