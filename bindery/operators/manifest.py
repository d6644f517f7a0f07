"""Rules of an import manifest: what each nested record breaks, all rules in one pass over the records.

A record links a work and an edition with people, dates, pictures and a batch of observations, or it brings observations alone. Rules are
columns under names, so a table of records gives an array of names, in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import offers, rules

#: Where credits may come from, and the kinds of publications.
CREDIT_SOURCES, PUBLICATIONS = ("", "verified_model_capture", "verified_press_source", "verified_publisher_source"), ("photobook", "magazine_issue")
RECORD = (
    "record_id long, work struct<id:string,title:string,origin:string,publication_type:string,issue_month:string,issue_number:string,featured_names:string,cover_url:string,issue_date:timestamp,issue_date_precision:string,issue_date_source_url:string>, "
    "edition struct<id:string,work_id:string,metadata_source_url:string,format:string,cover_url:string,cover_object_key:string,original_cover_url:string,release_date:timestamp,publication_date:timestamp,publication_date_precision:string,publication_date_source_url:string,"
    "store_release_date:timestamp,store_release_date_precision:string,store_release_date_source_url:string>, featured_people array<struct<slug:string,verification_source_url:string>>, cover_people array<struct<slug:string,verification_source_url:string>>, "
    "featured_credit_source string, source_id string, batch_source_id string, "
    "items array<struct<edition_id:string,format:string,status:string,currency:string,price_basis:string,price_minor:bigint,price_components:array<struct<basis:string,price_minor:bigint,currency:string,condition:string>>>>"
)


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _known(person: Column) -> Column:
    """A person who can be credited has a name for addresses and a secure source that verifies them."""
    return (F.trim(F.coalesce(person["slug"], F.lit(""))) != "") & F.coalesce(person["verification_source_url"], F.lit("")).rlike("^https://[^/\\s]+")


def _people_problem(c: str) -> Column:
    people = F.coalesce(F.col(c), F.filter(F.col(c), lambda p: F.lit(False)))
    slugs = F.transform(people, lambda p: p["slug"])
    return F.coalesce(F.exists(people, lambda p: ~_known(p)) | (F.size(F.array_distinct(slugs)) < F.size(slugs)), F.lit(False))


def is_warning_cover(url: Column) -> Column:
    """Whether an address is that of a picture that a store shows instead of a cover."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/?#]*)(?:[?#].*)?$", 1))
    return name.isin(*rules.PLACEHOLDERS) | name.rlike(r"_mask\.[a-z]+$")


def _primary(item: Column) -> Column:
    """The basis and the amount that stand for an observation: those of its first component by basis, else its own."""
    first = F.when(F.size(item["price_components"]) > 0, offers.primary_component(item["price_components"]))
    own = F.struct(F.coalesce(item["price_basis"], F.lit("")).alias("basis"), item["price_minor"].alias("price"), F.coalesce(item["currency"], F.lit("")).alias("currency"))
    return F.when(first.isNotNull(), F.struct(first["basis"].alias("basis"), first["price_minor"].alias("price"), first["currency"].alias("currency"))).otherwise(own)


def _bad_price(item: Column, typed: Column) -> Column:
    p = _primary(item)
    parts = F.when(F.size(item["price_components"]) > 0, offers.components_problem(item["price_components"]))
    # An observation that states an amount and components must state the same.
    differs = (F.size(item["price_components"]) > 0) & (((item["price_minor"] != 0) & (item["price_minor"] != p["price"])) | ((F.coalesce(item["price_basis"], F.lit("")) != "") & (item["price_basis"] != p["basis"])))
    untyped = typed & (F.coalesce(p["price"], F.lit(0)) > 0) & ((p["basis"] == "") | (p["currency"] == ""))
    return F.coalesce(offers.price_basis_problem(item["format"], item["status"], p["basis"]).isNotNull(), F.lit(False)) | parts.isNotNull() | F.coalesce(differs, F.lit(False)) | F.coalesce(untyped, F.lit(False))


def manifest_rules(origins: tuple[str, ...]) -> dict[str, Column]:
    """{name: whether a record of the columns of RECORD breaks it}. `origins`: the catalog's codes of countries."""
    items = F.coalesce(F.col("items"), F.filter(F.col("items"), lambda x: F.lit(False)))
    linked = (_text("work.id") != "") | (_text("edition.id") != "") | (_text("source_id") == "") | (_text("batch_source_id") != _text("source_id")) | (F.coalesce(F.size("items"), F.lit(0)) <= 0)
    kind = F.when(_text("work.publication_type") == "", "photobook").otherwise(F.col("work.publication_type"))
    issue, cover = kind == "magazine_issue", F.get(F.col("cover_people"), F.lit(0))
    korean = F.upper(_text("work.origin")) == "KR"
    dated = lambda c: offers.sourced_date_problem(F.col(c), F.col(f"{c}_precision"), F.col(f"{c}_source_url")).isNotNull()
    pictures = [F.col(c) for c in ("work.cover_url", "edition.cover_url", "edition.cover_object_key")] + [F.when(_text("edition.cover_url") != "", F.col("edition.original_cover_url"))]
    warning = F.lit(False)
    for p in pictures:
        warning = warning | is_warning_cover(p)
    of_edition = {
        "publication_type": ~kind.isin(*PUBLICATIONS),
        "issue_identity": issue & (~_text("work.issue_month").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$") | ~F.coalesce(_known(cover), F.lit(False))),
        "photobook_identity": (kind != "magazine_issue") & ((_text("work.featured_names") == "") | (_text("work.issue_month") != "") | (_text("work.issue_number") != "") | F.col("work.issue_date").isNotNull()),
        "issue_date": dated("work.issue_date"), "publication_date": dated("edition.publication_date"), "store_release_date": dated("edition.store_release_date"),
        "ambiguous_release_date": korean & F.col("edition.release_date").isNotNull(),
        "catalog_identity": (_text("work.id") == "") | (_text("work.title") == "") | F.contains(_text("work.title"), F.lit("??")) | ~F.coalesce(F.col("work.origin").isin(*origins), F.lit(False)) | (_text("edition.id") == "")
        | ~F.col("edition.work_id").eqNullSafe(F.col("work.id")) | (_text("edition.metadata_source_url") == ""),
        "format": ~F.coalesce(F.col("edition.format").isin("physical", "digital"), F.lit(False)),
        "warning_cover": warning,
        "source_mismatch": (F.size(items) > 0) & ((_text("source_id") == "") | (_text("batch_source_id") != _text("source_id"))),
        "listing_mismatch": F.exists(items, lambda x: ~(x["edition_id"].eqNullSafe(F.col("edition.id")) & x["format"].eqNullSafe(F.col("edition.format")))),
        "price": F.exists(items, lambda x: _bad_price(x, korean)),
    }
    return {
        "featured_people": _people_problem("featured_people"), "credit_source": ~F.coalesce("featured_credit_source", F.lit("")).isin(*CREDIT_SOURCES), "cover_people": _people_problem("cover_people"),
        "linked_observation": ~linked & F.exists(items, lambda x: F.coalesce(x["edition_id"], F.lit("")) != ""), **{k: linked & v for k, v in of_edition.items()},
    }


def manifest_problems(records: DataFrame, origins: tuple[str, ...] = ("JP", "KR", "TW")) -> DataFrame:
    """(record_id, problem): a row for each rule that a record breaks."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in manifest_rules(origins).items())))
    return records.select("record_id", F.explode(broken).alias("problem"))
