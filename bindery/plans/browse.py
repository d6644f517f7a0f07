"""Catalog browsing: ledgers, directories, book pages and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import offers, texts
from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry, with_tables
from bindery.storage import Scratch

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)


def filtered(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Every condition that is given."""
    return reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def contains_text(q: str, *columns: str) -> Column:
    """Case-insensitive containment in any column; % and _ of the query stay wildcards."""
    return reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{q}%") for c in columns))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Listings with a published edition of their format, of a published work."""
    e = T.editions(spark, d).where("edition_status = 'published'").withColumnRenamed("format", "e_format").drop("work_id")
    w = T.works(spark, d).where("work_status = 'published'")
    return T.listings(spark, d).join(e, "edition_id").where("format = e_format").join(w, "work_id")


_LEDGER = """ledger AS (
  SELECT l.*, w.title, w.publisher, w.publication_type, e.publication_date FROM listings l JOIN editions e ON l.edition_id = e.edition_id AND l.format = e.format
  JOIN works w ON w.work_id = l.work_id WHERE e.edition_status = 'published' AND w.work_status = 'published')"""
_CATEGORY = """CASE WHEN format = 'digital' THEN 'digital_retail' WHEN kind = 'bookstore' THEN 'physical_retail'
    WHEN status = 'completed' THEN 'marketplace_sold' ELSE 'marketplace_asking' END"""
_PAGE = with_tables("listings", "editions", "works") + ",\n" + _LEDGER


@query(f"""{_PAGE}
SELECT listing_id, work_id, title, source_name, region, format, status, price_minor, currency, observed_at, {_CATEGORY} AS price_category
FROM ledger WHERE status = 'active' ORDER BY observed_at DESC, listing_id LIMIT 50""")
def active_listings_page(spark: SparkSession, d: str) -> DataFrame:
    df = ledger(spark, d).where("status = 'active'")
    return df.select(
        "listing_id", "work_id", "title", "source_name", "region", "format", "status", "price_minor", "currency", "observed_at",
        offers.price_category(F.col("format"), F.col("kind"), F.col("status")).alias("price_category"),
    ).orderBy(F.desc("observed_at"), "listing_id").limit(50)


@query(f"""{with_tables("observations", "sources", "works")},
sold AS (SELECT o.*, source_name, kind FROM observations o JOIN sources USING (source_id) WHERE status = 'completed' AND kind IN ('marketplace', 'auction')
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, work_id DESC, price_minor DESC, status DESC, quantity DESC) = 1)
SELECT listing_id, work_id, title, source_name, price_minor, currency, observed_at AS sold_at FROM sold JOIN works USING (work_id)
WHERE work_status = 'published' ORDER BY sold_at DESC, listing_id LIMIT 50""")
def sold_listings_page(spark: SparkSession, d: str) -> DataFrame:
    """Sales come from history: a listing that is offered again keeps its sale."""
    kinds = T.sources(spark, d).where(F.col("kind").isin(*offers.RESALE_KINDS)).select("source_id", "source_name")
    sold = T.newest_of(T.observations(spark, d).where("status = 'completed'").join(kinds, "source_id"), "listing_id")
    w = T.works(spark, d).where("work_status = 'published'").select("work_id", "title")
    out = sold.join(w, "work_id").select("listing_id", "work_id", "title", "source_name", "price_minor", "currency", F.col("observed_at").alias("sold_at"))
    return out.orderBy(F.desc("sold_at"), "listing_id").limit(50)


_OFFERS = """offers AS (
  SELECT l.listing_id, l.source_name, l.region, l.kind, l.format, l.status, l.price_minor, l.observed_at, w.title, w.work_id IS NOT NULL AS catalog_matched
  FROM listings l LEFT JOIN editions e ON l.edition_id = e.edition_id AND e.edition_status <> 'superseded' AND e.format = l.format
  LEFT JOIN works w ON w.work_id = e.work_id AND w.work_status = 'published'
  WHERE l.status <> 'ended' AND (l.kind = 'marketplace' OR (l.kind IN ('bookstore', 'digital_store') AND l.authorized AND l.format = 'digital')))"""


def marketplace_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers in scope, matched or not: conditions on editions and works belong to the joins."""
    e = T.editions(spark, d).where("edition_status <> 'superseded'").select(F.col("edition_id").alias("e_id"), F.col("format").alias("e_format"), F.col("work_id").alias("e_work"))
    w = T.works(spark, d).where("work_status = 'published'").select(F.col("work_id").alias("w_id"), "title")
    df = T.listings(spark, d).where("status <> 'ended'")
    df = df.where((F.col("kind") == "marketplace") | (F.col("kind").isin(*offers.STORE_KINDS) & F.col("authorized") & (F.col("format") == "digital")))
    df = df.join(e, (F.col("edition_id") == F.col("e_id")) & (F.col("format") == F.col("e_format")), "left").join(w, F.col("e_work") == F.col("w_id"), "left")
    return df.select("listing_id", "source_name", "region", "kind", "format", "status", "price_minor", "observed_at", "title", F.col("w_id").isNotNull().alias("catalog_matched"))


@query(f"""{with_tables("listings", "editions", "works")}, {_OFFERS}
SELECT region, kind, format, catalog_matched, count(*) AS n, count(DISTINCT title) AS titles, min(price_minor) AS low, max(price_minor) AS high
FROM offers GROUP BY region, kind, format, catalog_matched""")
def marketplace_offers_left(spark: SparkSession, d: str) -> DataFrame:
    return marketplace_offers(spark, d).groupBy("region", "kind", "format", "catalog_matched").agg(
        F.count("*").alias("n"), F.countDistinct("title").alias("titles"), F.min("price_minor").alias("low"), F.max("price_minor").alias("high")
    )


def after_cursor(observed: Column, key: Column, cursor: tuple) -> Column:
    """Rows beyond (moment, id) in the order newest first, then id."""
    return (observed < cursor[0]) | ((observed == cursor[0]) & (key > cursor[1]))


@query(f"""{with_tables("listings", "editions", "works")}, {_OFFERS},
c AS (SELECT observed_at AS o, listing_id AS i FROM offers ORDER BY observed_at DESC, listing_id LIMIT 1 OFFSET 99)
SELECT offers.*, (SELECT count(*) FROM offers) AS total FROM offers, c
WHERE observed_at < o OR (observed_at = o AND listing_id > i) ORDER BY observed_at DESC, listing_id LIMIT 25""")
def marketplace_offers_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The page after the hundredth offer, with one row more than a page to tell whether there is another; the total ignores the cursor."""
    df = Scratch(spark).put(marketplace_offers(spark, d), "offers")
    order = [F.desc("observed_at"), "listing_id"]
    total = df.count()
    end = df.orderBy(*order).offset(99).limit(1).select("observed_at", "listing_id").first()  # one row
    rows = df.limit(0) if end is None else df.where(after_cursor(F.col("observed_at"), F.col("listing_id"), (F.lit(end[0]).cast(dict(df.dtypes)["observed_at"]), F.lit(end[1]))))
    return rows.withColumn("total", F.lit(total).cast("long")).orderBy(*order).limit(25)


_DATES = """dates AS (
  SELECT e.work_id, max(coalesce(CASE WHEN e.format = 'digital' THEN e.store_date ELSE e.publication_date END, e.publication_date, e.store_date, e.release_date,
    CASE WHEN regexp_matches(issue_month, '^[0-9]{4}-(0[1-9]|1[0-2])$') THEN CAST(issue_month || '-01' AS DATE) END)) AS newest
  FROM editions e JOIN works w ON w.work_id = e.work_id WHERE e.edition_status = 'published' GROUP BY e.work_id)"""


def newest_dates(spark: SparkSession, d: str) -> DataFrame:
    """Sort key of works: the latest effective date of their editions, computed before the sort."""
    e = T.editions(spark, d).where("edition_status = 'published'").join(T.works(spark, d).select("work_id", "issue_month"), "work_id")
    date = offers.effective_date(F.col("format"), F.col("publication_date"), F.col("store_date"), F.col("release_date"), F.lit(None).cast("date"), F.col("issue_month"))
    return e.groupBy("work_id").agg(F.max(date).alias("newest"))


@query(f"""{with_tables("listings", "editions", "works")}, {_DATES}
SELECT w.work_id, title, publisher, newest FROM works w LEFT JOIN dates USING (work_id)
WHERE work_status = 'published' AND publication_type = 'photobook' AND origin_key IN (1, 2) AND (title ILIKE '%a%' OR publisher ILIKE '%a%')
  AND w.work_id IN (SELECT work_id FROM editions WHERE format = 'physical') AND EXISTS (
    SELECT 1 FROM listings l JOIN editions e ON e.edition_id = l.edition_id AND e.format = l.format WHERE e.work_id = w.work_id AND l.status = 'active')
  AND EXTRACT(YEAR FROM newest) >= 2001 ORDER BY newest DESC NULLS LAST, work_id LIMIT 24""")
def books_filtered_newest(spark: SparkSession, d: str) -> DataFrame:
    e = T.editions(spark, d)
    active = T.listings(spark, d).where("status = 'active'").join(e.select("edition_id", F.col("format").alias("f"), F.col("work_id").alias("w")), "edition_id")
    active = active.where("format = f").select(F.col("w").alias("work_id"))
    df = filtered(
        T.works(spark, d), F.col("work_status") == "published", F.col("publication_type") == "photobook", F.col("origin_key").isin(1, 2),
        contains_text("a", "title", "publisher"), None,
    )
    df = df.join(e.where("format = 'physical'").select("work_id"), "work_id", "left_semi").join(active, "work_id", "left_semi")
    df = df.join(newest_dates(spark, d), "work_id", "left").where(F.year("newest") >= 2001)
    return df.select("work_id", "title", "publisher", "newest").orderBy(F.desc_nulls_last("newest"), "work_id").limit(24)


@query(f"""{with_tables("works")}, p AS (SELECT * FROM works WHERE work_status = 'published')
SELECT work_id, title, (SELECT count(*) FROM p) AS total, CAST(ceil((SELECT count(*) FROM p) / 24.0) AS BIGINT) AS pages FROM p ORDER BY title, work_id LIMIT 24 OFFSET 24""")
def books_title_sort_page2(spark: SparkSession, d: str) -> DataFrame:
    df = T.works(spark, d).where("work_status = 'published'").select("work_id", "title")
    total = df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 24.0).alias("pages"))
    return df.orderBy("title", "work_id").offset(24).limit(24).join(F.broadcast(total))


@query(f"""{with_tables("works", "editions")}
SELECT e.edition_id, e.format, e.isbn, w.title FROM editions e JOIN works w USING (work_id) WHERE work_status = 'published' AND edition_id IN (20, 21, 44)""")
def edition_by_id(spark: SparkSession, d: str) -> DataFrame:
    e = T.editions(spark, d).where(F.col("edition_id").isin(20, 21, 44))
    return e.join(T.works(spark, d).where("work_status = 'published'"), "work_id").select("edition_id", "format", "isbn", "title")


@query(f"""{with_tables("works")}
SELECT r_name AS origin, count(w.work_id) AS works FROM region LEFT JOIN works w ON w.origin_key = r_regionkey AND work_status = 'published' AND publication_type = 'magazine_issue' GROUP BY r_name""")
def origin_counts(spark: SparkSession, d: str) -> DataFrame:
    """Origins without works stay, with a count of nothing."""
    w = T.works(spark, d).where("work_status = 'published' AND publication_type = 'magazine_issue'")
    r = T.table(spark, d, "region")
    return r.join(w, r["r_regionkey"] == w["origin_key"], "left").groupBy(F.col("r_name").alias("origin")).agg(F.count("work_id").alias("works"))


@query(f"""{with_tables("sources")} SELECT source_id, source_name, kind, source_format FROM sources WHERE enabled""")
def enabled_sources(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).where("enabled").select("source_id", "source_name", "kind", "source_format")


@query(f"""{with_tables("people", "credits", "works")}
SELECT p.person_id, p.name, count(DISTINCT c.work_id) AS works, string_agg(DISTINCT w.publisher, ',' ORDER BY w.publisher) AS publishers
FROM people p JOIN credits c USING (person_id) JOIN works w USING (work_id) WHERE w.work_status = 'published' AND p.name ILIKE '%1%'
GROUP BY p.person_id, p.name ORDER BY works DESC, person_id LIMIT 50""")
def directory_people(spark: SparkSession, d: str) -> DataFrame:
    c = T.credits(spark, d).join(T.works(spark, d).where("work_status = 'published'").select("work_id", "publisher"), "work_id")
    c = c.groupBy("person_id").agg(F.countDistinct("work_id").alias("works"), F.array_join(F.array_sort(F.collect_set("publisher")), ",").alias("publishers"))
    df = T.people(spark, d).where(contains_text("1", "name")).join(c, "person_id")
    return df.select("person_id", "name", "works", "publishers").orderBy(F.desc("works"), "person_id").limit(50)


@query(f"""{with_tables("works", "editions")}
SELECT publisher, count(DISTINCT w.work_id) AS works, count(*) AS editions, count(*) FILTER (WHERE format = 'digital' AND store_date IS NOT NULL) AS dated_digital
FROM works w JOIN editions e USING (work_id) WHERE work_status = 'published' AND edition_status = 'published' GROUP BY publisher""")
def directory_publishers(spark: SparkSession, d: str) -> DataFrame:
    e = T.editions(spark, d).where("edition_status = 'published'")
    df = T.works(spark, d).where("work_status = 'published'").join(e, "work_id")
    return df.groupBy("publisher").agg(
        F.countDistinct("work_id").alias("works"), F.count("*").alias("editions"), F.count_if((F.col("format") == "digital") & F.col("store_date").isNotNull()).alias("dated_digital")
    )


def media(spark: SparkSession, d: str) -> DataFrame:
    """Pages stand in for images of works."""
    p = T.table(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id")
    return p.select(
        k.alias("media_id"), (k % 200 + 1).alias("work_id"), F.when(k % 3 == 0, "display").when(k % 3 == 1, "copy").otherwise("link").alias("scope"),
        (k % 4 != 0).alias("reviewed"), F.col("url").alias("original"), F.when(k % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://media.example.org/"), k.cast("string"))).alias("storage"),
        (k % 5).cast("int").alias("quality"),
    )


_MEDIA = """media AS (
  SELECT page_id AS media_id, page_id % 200 + 1 AS work_id, CASE page_id % 3 WHEN 0 THEN 'display' WHEN 1 THEN 'copy' ELSE 'link' END AS scope, page_id % 4 <> 0 AS reviewed,
    url AS original, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://media.example.org/' || page_id END AS storage, CAST(page_id % 5 AS INT) AS quality FROM pages),
approved AS (
  SELECT * FROM media WHERE scope IN ('display', 'copy') AND reviewed AND regexp_matches(original, '^https://[^/ ]+/') AND regexp_matches(storage, '^https://[^/ ]+/')
    AND (scope = 'copy' OR original = storage))"""


@query(f"""{with_tables("works")}, {_MEDIA}
SELECT w.work_id, title, media_id, storage FROM works w LEFT JOIN (
  SELECT * FROM approved QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY quality DESC, media_id) = 1) m USING (work_id) WHERE work_status = 'published'""")
def directory_best_media(spark: SparkSession, d: str) -> DataFrame:
    """The best approved image of each work, if it has one."""
    m = media(spark, d)
    o, s = F.col("original"), F.col("storage")
    m = m.where(texts.media_approved(F.col("scope"), F.col("reviewed"), o, o, s, o, F.col("scope") == "copy"))
    best = T.latest(m, "work_id", order=[F.desc("quality"), "media_id"]).select("work_id", "media_id", "storage")
    return T.works(spark, d).where("work_status = 'published'").join(best, "work_id", "left").select("work_id", "title", "media_id", "storage")


@query(f"""{with_tables("works", "editions", "credits")}, {_DATES}
SELECT person_id, CAST(EXTRACT(YEAR FROM newest) AS INT) AS year, count(DISTINCT w.work_id) AS works
FROM credits JOIN works w USING (work_id) JOIN dates USING (work_id) WHERE work_status = 'published' AND role = 'featured' GROUP BY person_id, year""")
def person_books_by_year(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    c = T.credits(spark, d).where("role = 'featured'").where(only).join(T.works(spark, d).where("work_status = 'published'"), "work_id")
    return c.join(newest_dates(spark, d), "work_id").groupBy("person_id", F.year("newest").alias("year")).agg(F.countDistinct("work_id").alias("works"))


@query(f"""{with_tables("works", "credits", "people")}
SELECT work_id, title FROM works w WHERE title ILIKE '%re%' OR EXISTS (SELECT 1 FROM credits c JOIN people p USING (person_id) WHERE c.work_id = w.work_id AND p.name ILIKE '%99%')""")
def search_or_exists(spark: SparkSession, d: str) -> DataFrame:
    """A title hit, or a credited person whose name has the text: an existence join, not a fan-out."""
    hit = T.credits(spark, d).join(T.people(spark, d).where(contains_text("99", "name")).select("person_id"), "person_id", "left_semi")
    hit = hit.select("work_id").distinct().withColumn("hit", F.lit(True))
    return T.works(spark, d).join(hit, "work_id", "left").where(contains_text("re", "title") | F.col("hit")).select("work_id", "title")


@query(f"""{with_tables("people")}
SELECT alias, min(person_id) AS person_id FROM people GROUP BY alias HAVING count(DISTINCT person_id) = 1""")
def canonical_slug(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that lead to one person only."""
    return T.people(spark, d).groupBy("alias").agg(F.min("person_id").alias("person_id"), F.countDistinct("person_id").alias("n")).where("n = 1").drop("n")


@query(f"""{with_tables("works", "editions", "listings")}
SELECT w.work_id, title, string_agg(e.edition_id || ' ' || e.format || ' ' || coalesce(n, 0), ', ' ORDER BY e.edition_id) AS editions
FROM works w JOIN editions e USING (work_id) LEFT JOIN (SELECT edition_id, count(*) AS n FROM listings GROUP BY edition_id) l ON l.edition_id = e.edition_id
GROUP BY w.work_id, title""")
def nested_books(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Books with their editions nested, in edition order."""
    n = T.listings(spark, d).groupBy("edition_id").agg(F.count("*").alias("n"))
    e = T.editions(spark, d).where(only).join(n, "edition_id", "left")
    nest = F.array_sort(F.collect_list(F.struct("edition_id", "format", F.coalesce("n", F.lit(0)).alias("offers"))))
    return T.works(spark, d).where(only).join(e.groupBy("work_id").agg(nest.alias("nested")), "work_id").select(
        "work_id", "title", F.array_join(F.transform("nested", lambda x: F.concat_ws(" ", x["edition_id"].cast("string"), x["format"], x["offers"].cast("string"))), ", ").alias("editions")
    )


@query(f"""{with_tables("works", "editions")}, {_MEDIA}
SELECT w.work_id, count(m.media_id) AS images, string_agg(m.media_id, ',' ORDER BY m.media_id) AS ids FROM works w
LEFT JOIN (SELECT 'work' AS entity, work_id AS id, media_id FROM approved UNION ALL SELECT 'edition', work_id * 2, media_id FROM approved WHERE quality = 4) m
  ON (entity = 'work' AND id = w.work_id) OR (entity = 'edition' AND id IN (w.work_id * 2, w.work_id * 2 + 1)) GROUP BY w.work_id""")
def media_by_entity(spark: SparkSession, d: str) -> DataFrame:
    """Media hang on works or on editions: keyed joins of stacked ids, instead of one join with alternatives."""
    m = media(spark, d)
    o, s = F.col("original"), F.col("storage")
    m = m.where(texts.media_approved(F.col("scope"), F.col("reviewed"), o, o, s, o, F.col("scope") == "copy"))
    on_work = m.select(F.lit("work").alias("entity"), F.col("work_id").alias("id"), "media_id")
    on_edition = m.where("quality = 4").select(F.lit("edition").alias("entity"), (F.col("work_id") * 2).alias("id"), "media_id")
    w = T.works(spark, d).select("work_id")
    ids = w.select("work_id", F.lit("work").alias("entity"), F.col("work_id").alias("id")).unionByName(
        T.editions(spark, d).select("work_id", F.lit("edition").alias("entity"), F.col("edition_id").alias("id"))
    )
    found = ids.join(on_work.unionByName(on_edition), ["entity", "id"]).groupBy("work_id").agg(
        F.count("*").alias("images"), F.array_join(F.transform(F.array_sort(F.collect_list("media_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    return w.join(found, "work_id", "left").select("work_id", F.coalesce("images", F.lit(0)).alias("images"), "ids")


@query(f"""{with_tables("credits", "works")},
c AS (SELECT DISTINCT person_id, work_id, title FROM credits JOIN works USING (work_id) WHERE work_status = 'published' AND role = 'featured'),
f AS (SELECT work_id, min(person_id) AS person_id FROM c GROUP BY work_id)
SELECT f.work_id, c.work_id AS related, rn AS place FROM (
  SELECT f.work_id, c.work_id AS other, row_number() OVER (PARTITION BY f.work_id ORDER BY c.work_id DESC) AS rn FROM f JOIN c ON c.person_id = f.person_id AND c.work_id <> f.work_id) x
JOIN f ON f.work_id = x.work_id JOIN c ON c.work_id = x.other AND c.person_id = f.person_id WHERE rn <= 6""")
def related_works(spark: SparkSession, d: str, people: str = "true", only: str = "true") -> DataFrame:
    """Six newest other works of the first person a work credits."""
    c = T.credits(spark, d).where("role = 'featured'").where(people).join(T.works(spark, d).where("work_status = 'published'").select("work_id"), "work_id").select("person_id", "work_id").distinct()
    first = c.where(only).groupBy("work_id").agg(F.min("person_id").alias("person_id"))
    pairs = first.join(c.withColumnRenamed("work_id", "related"), "person_id").where("related <> work_id")
    w = Window.partitionBy("work_id").orderBy(F.desc("related"))
    return pairs.select("work_id", "related", F.row_number().over(w).alias("place")).where("place <= 6")
