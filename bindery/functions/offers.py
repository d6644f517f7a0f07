"""Formats, prices, statuses and dates of offers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format synonyms.
PHYSICAL_WORDS = ("physical", "print", "printed", "hardcopy", "paper")
DIGITAL_WORDS = ("digital", "ebook", "e-book", "epub", "pdf")
#: Which amount stands for an offer that states several.
BASIS_ORDER = ("sale", "list", "used_asking", "completed_sale", "coupon")
STORE_KINDS = ("bookstore", "digital_store")
RESALE_KINDS = ("marketplace", "marketplace_c2c", "auction", "flea_market")
WHOLE_CURRENCIES = ("JPY", "KRW")


def normal_format(raw: Column) -> Column:
    """physical, digital or ''."""
    c = F.lower(F.trim(raw))
    return F.when(c.isin(*PHYSICAL_WORDS), "physical").when(c.isin(*DIGITAL_WORDS), "digital").otherwise("")


def source_format(kind: Column) -> Column:
    """The format a kind of source deals in by itself."""
    return F.when(kind == "digital_store", "digital").otherwise("physical")


def effective_format(candidate: Column, price_type: Column, kind: Column) -> Column:
    """The stated format, else what the price type and then the source imply."""
    stated = F.nullif(normal_format(candidate), F.lit(""))
    implied = F.when(price_type == "digital", "digital").when(kind.isin(*RESALE_KINDS), "physical")
    return F.coalesce(stated, implied, source_format(kind))


def minor_units(amount: Column, currency: Column) -> Column:
    """Half-up minor units; currencies without a minor unit stay whole."""
    d = amount.cast("decimal(18,4)")
    return F.when(currency.isin(*WHOLE_CURRENCIES), F.round(d, 0)).otherwise(F.round(d * 100, 0)).cast("long")


def price_category(fmt: Column, kind: Column, status: Column) -> Column:
    """What an amount means in the ledgers: digital first, then the store's retail price, then sales."""
    return (
        F.when(fmt == "digital", "digital_retail")
        .when(kind == "bookstore", "physical_retail")
        .when(status == "completed", "marketplace_sold")
        .otherwise("marketplace_asking")
    )


def price_category_with_used(fmt: Column, kind: Column, status: Column, title: Column) -> Column:
    """The response variant: a bookstore's titles marked as used are marketplace prices."""
    used = F.startswith(title, F.lit("[중고]"))
    return F.when((fmt != "digital") & (kind == "bookstore") & used, "marketplace_asking").otherwise(price_category(fmt, kind, status))


def listing_fits_edition(listing_format: Column, edition_format: Column, price_type: Column, status: Column) -> Column:
    """Not excluded, and of one format; a blank format fits where the price type agrees."""
    blank = (F.coalesce(listing_format, F.lit("")) == "") & ((price_type == "digital") == (edition_format == "digital"))
    return (status != "excluded") & ((listing_format == edition_format) | blank)


def price_type_problem(fmt: Column, status: Column, price_type: Column) -> Column:
    """Reason why a price type can't stand, or null."""
    return (
        F.when((fmt == "digital") & (status == "completed"), "digital_completed")
        .when((fmt == "digital") & ~price_type.isin("", "digital"), "digital_price_type")
        .when((fmt == "physical") & (price_type == "digital"), "physical_digital_price")
        .when((price_type == "hammer") & (status != "completed"), "hammer_not_completed")
        .when((price_type == "current") & (status == "completed"), "current_completed")
    )


def price_basis_problem(fmt: Column, status: Column, basis: Column) -> Column:
    """Reason why a price basis can't stand, or null; a blank basis is legacy and passes."""
    return (
        F.when(basis.isin("list", "sale", "coupon") & (status == "completed"), "retail_basis_sold")
        .when((basis == "used_asking") & ((fmt != "physical") | (status == "completed")), "used_asking")
        .when((basis == "completed_sale") & (status != "completed"), "completed_sale_open")
        .when(~basis.isin("", *BASIS_ORDER), "unknown_basis")
    )


def components_problem(c: Column) -> Column:
    """Reason why price components (array of basis, price_minor, currency, condition) can't stand together, or null."""
    bases = F.transform(c, lambda x: x["basis"])
    return (
        F.when(F.exists(c, lambda x: x["price_minor"] < 0), "negative")
        .when(F.exists(c, lambda x: (x["basis"] != "") & x["price_minor"].isNull()), "amount_missing")
        .when(F.exists(c, lambda x: (x["basis"] == "coupon") & (F.coalesce(x["condition"], F.lit("")) == "")), "coupon_condition")
        .when(F.size(F.array_distinct(bases)) < F.size(bases), "repeated_basis")
        .when(F.size(F.array_distinct(F.transform(c, lambda x: x["currency"]))) > 1, "currencies_differ")
        .when((F.size(c) > 1) & F.exists(bases, lambda b: b.isin("used_asking", "completed_sale")), "used_not_alone")
    )


def primary_component(c: Column) -> Column:
    """The component whose basis comes first in BASIS_ORDER."""
    order = F.array(*map(F.lit, BASIS_ORDER))
    ranked = F.transform(c, lambda x: F.struct(F.array_position(order, x["basis"]).alias("rank"), x.alias("component")))
    return F.element_at(F.array_sort(F.filter(ranked, lambda x: x["rank"] > 0)), 1)["component"]


def status_rank(status: Column) -> Column:
    """Order in which listings stand for their group: active, unknown, completed, then any."""
    return F.when(status == "active", 0).when(status == "unknown", 1).when(status == "completed", 2).otherwise(3)


def retry_delay(attempt: Column) -> Column:
    """Seconds before a failed job may run again: 15, doubling up to six times."""
    return (F.lit(15) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(6)))).cast("long")


def lease_seconds(asked: Column) -> Column:
    """Five minutes unless asked otherwise, an hour at most."""
    return F.when(F.coalesce(asked, F.lit(0)) <= 0, 300).otherwise(F.least(asked, F.lit(3600)))


def edition_date(fmt: Column, publication: Column, store: Column, release: Column) -> Column:
    """Order date of an edition: digital ones by their store's date."""
    return F.when(fmt == "digital", store).otherwise(publication)


def effective_date(fmt: Column, publication: Column, store: Column, release: Column, issue_date: Column, issue_month: Column) -> Column:
    """The first date that is known, down to the first day of a well-formed issue month."""
    month = F.when(issue_month.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(issue_month, F.lit("-01"))))
    return F.coalesce(edition_date(fmt, publication, store, release), publication, store, release, issue_date, month)


def partial_date(value: Column, precision: Column) -> Column:
    """A date cut to its precision: month to the first, year to the first of January."""
    return F.when(precision == "month", F.date_trunc("month", value)).when(precision == "year", F.date_trunc("year", value)).otherwise(F.date_trunc("day", value))


def sourced_date_problem(value: Column, precision: Column, url: Column) -> Column:
    blank = (F.coalesce(precision, F.lit("")) == "") & (F.coalesce(url, F.lit("")) == "")
    whole = precision.isin("day", "month", "year") & F.startswith(url, F.lit("https://"))
    return F.when(value.isNull() & ~blank, "date_missing").when(value.isNotNull() & ~F.coalesce(whole, F.lit(False)), "source_missing")


def day_bounds(moment: Column, zone: str) -> list[Column]:
    """First and last moment (UTC, inclusive, to the second) of the local day of a UTC moment."""
    local = F.date_trunc("day", F.from_utc_timestamp(moment, zone))
    start = F.to_utc_timestamp(local, zone)
    end = F.to_utc_timestamp(local + F.expr("INTERVAL 1 DAY"), zone) - F.expr("INTERVAL 1 SECOND")
    return [start.alias("day_start"), end.alias("day_end")]
