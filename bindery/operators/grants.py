"""Reviewed grants for the data of a source: what a use needs, what a grant allows, and whether it did when data was captured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.intervals import interval_join, merged

#: Display modes of a grant, and those that a catalog may show.
DISPLAY_MODES, SHOWN_MODES = ("none", "source_linked", "attributed", "integrated", "separate_source_labeled"), ("source_linked", "attributed", "integrated")
#: Uses that evidence of a catalog record needs.
CATALOG_USES = ("collect", "retain", "catalog_display")
#: Price bases of used books.
USED_BASES = ("used_asking", "completed_sale")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _low(c) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def csv_set(c: Column) -> Column:
    """The names of a comma-separated list, trimmed and lower-cased."""
    return F.filter(F.array_distinct(F.transform(F.split(F.coalesce(c, F.lit("")), ","), _low)), lambda x: x != "")


def names(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def lasting_denial(method: Column, uses: Column) -> Column:
    """First reason, apart from times and fields, why a grant doesn't allow `uses` by the source's access `method`; null if none.

    Columns: status, access_method, purpose, allowed_uses, retention_mode, retention_days, retention_policy, display_mode, attribution_required,
    attribution_text, redistribution_allowed, rate_per_minute, rightsholder, territory, evidence_url, reviewed_at, effective_at.
    """
    mode, kept = _low(F.col("display_mode")), _low(F.col("retention_mode"))
    wants = lambda use: F.array_contains(uses, use)
    url = F.trim(F.coalesce("evidence_url", F.lit("")))
    return (
        F.when(F.coalesce("status", F.lit("")) != "approved", "status")
        .when(_low(F.col("access_method")) != _low(method), "method")
        .when(F.col("reviewed_at").isNull(), "not_reviewed")
        .when(F.col("effective_at").isNull(), "not_effective")
        .when(_blank("purpose"), "purpose")
        .when(F.coalesce("rate_per_minute", F.lit(0)) <= 0, "rate")
        .when(_blank("retention_policy"), "retention_policy")
        .when(_blank("rightsholder"), "rightsholder")
        .when(_blank("territory"), "territory")
        .when(~mode.isin(*DISPLAY_MODES), "display_mode")
        .when(~url.rlike("^https://[^/@\\s]+(/|$)"), "evidence_url")
        .when(F.size(F.array_except(uses, csv_set(F.col("allowed_uses")))) > 0, "uses")
        .when(wants("catalog_display") & ~mode.isin(*SHOWN_MODES), "display")
        .when(wants("redistribute") & ~F.coalesce("redistribution_allowed", F.lit(False)), "redistribution")
        .when(wants("retain") & (kept != "permanent"), "retention")
        .when((kept == "temporary") & (F.coalesce("retention_days", F.lit(0)) <= 0), "retention_days")
        .when((F.coalesce("attribution_required", F.lit(False)) | (mode == "attributed")) & _blank("attribution_text"), "attribution")
        .when((mode == "attributed") & ~F.coalesce("attribution_required", F.lit(False)), "attribution")
    )


def denial(source_id: Column, method: Column, scope: Column, fields: Column, uses: Column, moment: Column) -> Column:
    """First reason why a grant doesn't allow `uses` of `fields` of a source and scope at a moment; null if it does."""
    return (
        F.when(F.col("source_id") != source_id, "source").when(F.col("scope") != scope, "scope")
        .otherwise(F.coalesce(
            lasting_denial(method, uses),
            F.when(F.col("effective_at") > moment, "not_effective").when(F.col("expires_at") <= moment, "expired"),
            F.when(F.size(F.array_except(F.transform(fields, _low), csv_set(F.col("allowed_fields")))) > 0, "fields"),
        ))
    )


def observation_scope(status: Column, basis: Column, price: Column, components: Column, price_type: Column, currency: Column) -> Column:
    """The grant that an observation needs: used prices, current prices or bibliography."""
    used = _low(status).isin("completed", "sold") | _low(basis).isin(*USED_BASES) | F.coalesce(F.exists(components, lambda x: _low(x["basis"]).isin(*USED_BASES)), F.lit(False))
    priced = (F.coalesce(price, F.lit(0)) != 0) | (F.coalesce(F.size(components), F.lit(0)) > 0) | (_low(price_type) != "") | (_low(currency) != "")
    return F.when(used, "used_prices").when(priced, "current_prices").otherwise("bibliography")


def observation_fields(status: Column, isbn: Column, publisher: Column, variant: Column, price: Column, components: Column, condition: Column, location: Column, shipping: Column, image: Column) -> Column:
    """The fields that an observation fills, in the order in which grants list them."""
    listed = F.coalesce(F.size(components), F.lit(0)) > 0
    priced = (F.coalesce(price, F.lit(0)) != 0) | listed
    optional = [
        (_low(status) != "", "availability"), (_low(isbn) != "", "isbn"), (_low(publisher) != "", "publisher"), (_low(variant) != "", "edition_variant"), (priced, "price"), (priced, "currency"), (priced, "price_basis"),
        (listed, "price_components"), (_low(condition) != "", "condition"), (_low(location) != "", "seller_location"), (_low(shipping) != "", "shipping"), (_low(image) != "", "image_url"),
    ]
    return F.array_compact(F.array(*map(F.lit, ("title", "url", "format", "observed_at")), *(F.when(c, F.lit(f)) for c, f in optional)))


def observation_scopes(scope: Column, image: Column) -> Column:
    """The grants that an observation needs in all: a picture needs one of its own."""
    return F.when(_low(image) != "", F.array(scope, F.lit("product_images"))).otherwise(F.array(scope))


def authorized(captures: DataFrame, grants: DataFrame, sources: DataFrame, now: Column, uses: tuple[str, ...] = CATALOG_USES) -> DataFrame:
    """(source_id, scope, captured_at, verdict) of each capture in `captures` (source_id, scope, captured_at, field).

    One grant must allow all fields of a capture, both now and when they were captured, and must have been reviewed by then.
    Verdicts: `future` beyond a minute from now, `no_grant` if none allows the fields now, `not_then`, `authorized`. `sources`
    gives source_id and method. Grants of one source, scope and set of fields are united into spans before the captures look theirs up
    by time, so neither many grants nor many captures of a source meet as pairs.
    """
    each = captures.select("source_id", "scope", "captured_at", _low(F.col("field")).alias("field")).distinct()  # hashed, before sets are gathered
    asked = each.groupBy("source_id", "scope", "captured_at").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    good = grants.join(sources.select("source_id", "method"), "source_id").where(lasting_denial(F.col("method"), names(*uses)).isNull())
    good = good.where((F.col("effective_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    spans = good.select("source_id", "scope", F.array_sort(csv_set(F.col("allowed_fields"))).alias("allowed"), F.greatest("effective_at", "reviewed_at").alias("since"), F.col("expires_at").alias("until"))
    spans = merged(spans, ["source_id", "scope", "allowed"], "since", "until")
    covers = F.size(F.array_except("fields", "allowed")) == 0
    sets = asked.select("source_id", "scope", "fields").distinct().join(spans.select("source_id", "scope", "allowed").distinct(), ["source_id", "scope"]).where(covers)
    sets = sets.select("source_id", "scope", "fields", F.lit(True).alias("now_ok")).distinct()
    then = interval_join(asked, spans, ["source_id", "scope"], "captured_at", "since", "until").where(covers)
    then = then.select("source_id", "scope", "captured_at", F.lit(True).alias("then_ok")).distinct()
    out = asked.join(sets, ["source_id", "scope", "fields"], "left").join(then, ["source_id", "scope", "captured_at"], "left")
    verdict = F.when(F.col("captured_at") > now + F.expr("INTERVAL 1 MINUTE"), "future").when(F.col("now_ok").isNull(), "no_grant").when(F.col("then_ok").isNull(), "not_then").otherwise("authorized")
    return out.select("source_id", "scope", "captured_at", verdict.alias("verdict"))
