"""Completeness of source evidence: every filled field of a nested record needs one piece of evidence, with its own address and scope.

What a record expects is read from its schema. A record has `record_id`, entities (structs with an `id`), lists of people and of media,
and `source_evidence`. Every plain field of an entity is expected if it is filled. A field with a sibling `<field>_source_url` is
evidenced by that address, and its sibling `<field>_precision`, if it has one, by the same; all others by the edition's `metadata_source_url`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Fields that every record must have evidence for, pictures, and lists of names evidenced by their credit's address.
ALWAYS = {("work", "title"), ("work", "origin"), ("edition", "metadata_source_url"), ("edition", "format")}
PICTURES = ("cover_url", "original_cover_url", "cover_object_key")
CREDITED = {("work", "featured_names"): "featured"}
#: Names under which grants know fields that they call otherwise.
GRANT_NAMES = {"metadata_source_url": "url", "featured_names": "model_credit"}
EVIDENCE = "source_evidence array<struct<entity_type:string,entity_id:string,source_id:string,scope:string,source_url:string,captured_at:timestamp,fields:array<string>>>"
_KEY = ["record_id", "entity_type", "entity_id", "field"]


def _filled(c: Column, kind: str) -> Column:
    if kind == "string":
        return F.trim(F.coalesce(c, F.lit(""))) != ""
    return c.isNotNull() & (c != 0) if kind in ("int", "bigint", "smallint", "double") else c.isNotNull()


def _piece(filled: Column, entity: Column | str, eid: Column, field: Column | str, grant: Column | str, scope: str, url: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        filled.alias("filled"), lit(entity).alias("entity_type"), F.coalesce(eid.cast("string"), F.lit("")).alias("entity_id"), lit(field).alias("field"), lit(grant).alias("grant_field"), F.lit(scope).alias("scope"),
        F.coalesce(url, F.lit("")).alias("url"),
    )


def _credit_url(role: str) -> Column:
    own = F.trim(F.coalesce(F.col(f"{role}_credit_source_url"), F.lit("")))
    return F.when(own != "", own).otherwise(F.trim("edition.metadata_source_url"))


def _people(column: str, role: str) -> list[Column]:
    """Each person's identity and credit."""
    grant, url = "cover_credit" if role == "cover" else "model_credit", _credit_url(role)
    who = lambda p: _piece(F.lit(True), "person", p["slug"], "identity", "model_identity", "bibliography", p["verification_source_url"])
    credit = lambda p: _piece(F.lit(True), "work_credit", F.col("work.id"), F.concat(F.lit(f"{role}:"), p["slug"]), grant, "bibliography", url)
    return [F.transform(column, who), F.transform(column, credit)]


def _media(column: str, entity: str) -> Column:
    piece = lambda m: _piece(F.lit(True), f"{entity}_image", F.col(f"{entity}.id"), m["media_type"], "image_url", "product_images", m["source_url"])
    return F.transform(column, piece)


def _pieces(schema: StructType) -> list[Column]:
    """What a record expects, as structs: one for each plain field of an entity, and one array of them for each list."""
    out, metadata = [], F.trim("edition.metadata_source_url")
    for entity in schema.fields:
        if isinstance(entity.dataType, StructType):
            name, inner = entity.name, {f.name: f.dataType.simpleString() for f in entity.dataType.fields}
            eid = F.col(f"{name}.id")
            helpers = {"id"} | {k for k in inner if k.endswith("_id")} | {k for f in inner for k in (f"{f}_source_url", f"{f}_precision") if k in inner}
            for field, kind in inner.items():
                if field in helpers:
                    continue
                value = F.col(f"{name}.{field}")
                filled = F.lit(True) if (name, field) in ALWAYS else _filled(value, kind)
                grant, scope, kept = GRANT_NAMES.get(field, field), "bibliography", name
                url = F.col(f"{name}.{field}_source_url") if f"{field}_source_url" in inner else metadata
                if field in PICTURES:
                    grant, scope, kept = "image_url", "product_images", f"{name}_image"
                if (name, field) in CREDITED:
                    url = _credit_url(CREDITED[name, field])
                out.append(F.array(_piece(filled, kept, eid, field, grant, scope, url)))
                if f"{field}_precision" in inner:
                    out.append(F.array(_piece(filled, kept, eid, f"{field}_precision", f"{field}_precision", scope, url)))
        elif isinstance(entity.dataType, ArrayType) and entity.name.endswith("_people"):
            out += _people(entity.name, entity.name.removesuffix("_people"))
        elif isinstance(entity.dataType, ArrayType) and entity.name.endswith("_media"):
            out.append(_media(entity.name, entity.name.removesuffix("_media")))
    return out


def _expected(records: DataFrame) -> Column:
    """Array of what a record expects."""
    none = F.expr("cast(array() as array<struct<filled:boolean,entity_type:string,entity_id:string,field:string,grant_field:string,scope:string,url:string>>)")
    pieces = F.concat(*(F.coalesce(p, none) for p in _pieces(records.schema)))
    return F.when(F.expr("work.id <> '' OR edition.id <> ''"), F.filter(pieces, lambda x: x["filled"])).otherwise(none)


def _problem(x: Column, y: Column) -> Column:
    """What is wrong with a field whose expected pieces lie between `x` and `y`."""
    return F.when((F.trim("entity_id") == "") | ~x["url"].rlike("^https://[^/\\s]+"), "unsourced").when(x != y, "conflict")


def expected_evidence(records: DataFrame) -> DataFrame:
    """(record_id, entity_type, entity_id, field, grant_field, scope, url, problem): problem is `unsourced` without an entity or a secure
    address, and `conflict` where a record expects a field twice and differently."""
    df, piece = records.select("record_id", F.inline(_expected(records))), F.struct("grant_field", "scope", "url")
    one = df.groupBy(*_KEY).agg(F.min(piece).alias("x"), F.max(piece).alias("y"))
    return one.select(*_KEY, "x.*", _problem(F.col("x"), F.col("y")).alias("problem"))


def provided_evidence(records: DataFrame) -> DataFrame:
    """(record_id, entity_type, entity_id, field, source_id, scope, url, captured_at, n): n pieces state the field."""
    e = records.select("record_id", F.inline("source_evidence")).select("*", F.explode("fields").alias("f"))
    x = F.min(F.struct("source_id", "scope", F.col("source_url").alias("url"), "captured_at")).alias("x")
    return e.groupBy("record_id", "entity_type", "entity_id", F.trim("f").alias("field")).agg(x, F.count("*").alias("n")).select(*_KEY, "x.*", "n")


def evidence_mismatches(records: DataFrame) -> DataFrame:
    """(record_id, entity_type, entity_id, field, gap): where what a record expects and what it provides part.

    Records are dealt out whole, once, by record_id: the pieces of both sides are made where a record is, and grouped there by keys that
    begin with it. A join of the two sides would deal out all pieces again, by all of its keys. A key with a null meets nothing.
    """
    piece = lambda x, side, e, p: F.struct(*(x[c].alias(c) for c in ("entity_type", "entity_id")), F.lit(side).alias("side"), e.alias("e"), p.alias("p"))
    no_e, no_p = F.expr("cast(null as struct<grant_field:string,scope:string,url:string>)"), F.expr("cast(null as struct<source_id:string,scope:string,url:string,captured_at:timestamp>)")
    named = lambda x, field, *rest: F.struct(field.alias("field"), piece(x, *rest).alias("x"))
    want = F.transform(_expected(records), lambda x: named(x, x["field"], "expected", F.struct(x["grant_field"], x["scope"], x["url"]), no_p))
    stated = lambda g: F.struct(g["source_id"], g["scope"], g["source_url"].alias("url"), g["captured_at"])
    given = F.transform("source_evidence", lambda g: F.coalesce(F.transform(g["fields"], lambda f: named(g, F.trim(f), "provided", no_e, stated(g))), F.array()))
    df = records.repartition("record_id").select("record_id", F.explode(F.concat(want, F.coalesce(F.flatten(given), F.array()))).alias("x")).select("record_id", "x.field", "x.x.*")
    alone = F.when(F.greatest(*(F.col(c).isNull() for c in _KEY)), F.col("side"))
    both = df.groupBy(*_KEY, alone.alias("alone")).agg(F.min("e").alias("x"), F.max("e").alias("y"), F.min("p").alias("p"), F.count("p").alias("n"))
    x, p = F.col("x"), F.col("p")
    gap = (
        F.when(F.col("n") > 1, "duplicate").when(x.isNull(), "extra").otherwise(F.coalesce(_problem(x, F.col("y")), F.when(F.col("n") == 0, "missing").when(x["url"] != p["url"], "url").when(x["scope"] != p["scope"], "scope")))
    )
    return both.select(*_KEY, gap.alias("gap")).where("gap IS NOT NULL")
