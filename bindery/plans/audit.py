"""Audits, coverage reports and front-end analytics over the catalog's stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import offers, texts
from bindery.operators import ordinals
from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry, with_tables
from bindery.storage import Scratch

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)

#: People of a work who are paired with each other at once; those of larger works are paired by smaller ones.
CROWD = 1000


@query(f"""{with_tables("editions", "listings", "works")}
SELECT format, count(*) AS editions, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM listings l WHERE l.edition_id = e.edition_id AND l.format = e.format AND l.status = 'active' AND l.price_minor > 0)) AS priced
FROM editions e WHERE edition_status = 'published' GROUP BY format""")
def price_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Editions with and without a usable asking price."""
    l = T.listings(spark, d).where("status = 'active' AND price_minor > 0").select("edition_id", F.col("format").alias("f")).distinct().withColumn("priced", F.lit(True))
    e = T.editions(spark, d).where("edition_status = 'published'")
    e = e.join(l.withColumnRenamed("edition_id", "i"), (F.col("edition_id") == F.col("i")) & (F.col("format") == F.col("f")), "left")
    return e.groupBy("format").agg(F.count("*").alias("editions"), F.count_if("priced").alias("priced"))


@query(f"""{with_tables("editions", "listings", "works")}
SELECT e.edition_id, title FROM editions e JOIN works w USING (work_id) WHERE edition_status = 'published' AND work_status = 'published'
  AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.edition_id = e.edition_id AND l.status = 'active')""")
def price_audit_missing(spark: SparkSession, d: str) -> DataFrame:
    e = T.editions(spark, d).where("edition_status = 'published'").join(T.works(spark, d).where("work_status = 'published'").select("work_id", "title"), "work_id")
    return e.join(T.listings(spark, d).where("status = 'active'").select("edition_id"), "edition_id", "left_anti").select("edition_id", "title")


@query(f"""{with_tables("listings")} SELECT source_name, kind, count(*) AS n, count(*) FILTER (WHERE edition_id IS NULL) AS unlinked, count(*) FILTER (WHERE status = 'active' AND price_minor > 1000000) AS dear FROM listings GROUP BY source_name, kind""")
def price_audit_sources(spark: SparkSession, d: str) -> DataFrame:
    dear = (F.col("status") == "active") & (F.col("price_minor") > 1000000)
    return T.listings(spark, d).groupBy("source_name", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("edition_id").isNull()).alias("unlinked"), F.count_if(dear).alias("dear"))


@query(f"""{with_tables("listings")} SELECT listing_id, CASE WHEN format = 'digital' AND status = 'completed' THEN 'digital_sold' WHEN price_minor <= 0 THEN 'no_price' ELSE 'odd_quantity' END AS issue
FROM listings WHERE (format = 'digital' AND status = 'completed') OR price_minor <= 0 OR quantity > 49""")
def price_audit_invalid(spark: SparkSession, d: str) -> DataFrame:
    issue = F.when((F.col("format") == "digital") & (F.col("status") == "completed"), "digital_sold").when(F.col("price_minor") <= 0, "no_price").when(F.col("quantity") > 49, "odd_quantity")
    return T.listings(spark, d).select("listing_id", issue.alias("issue")).where("issue IS NOT NULL")


@query(f"""{with_tables("listings", "observations")}, n AS (SELECT listing_id, count(*) AS k FROM observations GROUP BY listing_id)
SELECT region, count(*) AS listings, CAST(sum(k) AS BIGINT) AS observations, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'completed' AND format = 'physical') AS sold, count(DISTINCT work_id) AS works
FROM listings JOIN n USING (listing_id) GROUP BY region""")
def regional_audit(spark: SparkSession, d: str) -> DataFrame:
    n = T.observations(spark, d).groupBy("listing_id").agg(F.count("*").alias("k"))
    return T.listings(spark, d).join(n, "listing_id").groupBy("region").agg(
        F.count("*").alias("listings"), F.sum("k").alias("observations"), F.count_if(F.col("status") == "active").alias("active"),
        F.count_if((F.col("status") == "completed") & (F.col("format") == "physical")).alias("sold"), F.countDistinct("work_id").alias("works"),
    )


@query(f"""{with_tables("listings", "editions")},
x AS (SELECT listing_id AS id, edition_id AS want, price_minor AS p, CASE WHEN quantity = 3 THEN 'ended' ELSE status END AS s FROM listings WHERE work_id % 3 = 0
  UNION ALL SELECT listing_id || 'x', edition_id, price_minor, status FROM listings WHERE work_id % 300 = 1)
SELECT count(*) AS expected, count(l.listing_id) AS found, count(*) FILTER (WHERE l.listing_id IS NULL) AS missing, count(*) FILTER (WHERE l.listing_id IS NOT NULL AND l.status IS DISTINCT FROM s) AS status_differs,
  count(*) FILTER (WHERE l.listing_id IS NOT NULL AND (want, p) IS DISTINCT FROM (l.edition_id, l.price_minor)) AS link_differs, count(*) FILTER (WHERE e.edition_status = 'superseded') AS superseded
FROM x LEFT JOIN listings l ON l.listing_id = x.id LEFT JOIN editions e ON e.edition_id = l.edition_id""")
def import_verification(spark: SparkSession, d: str) -> DataFrame:
    """A manifest against what is stored, with null-safe comparisons."""
    l = T.listings(spark, d)
    a = l.where("work_id % 3 = 0").select(F.col("listing_id").alias("id"), F.col("edition_id").alias("want"), F.col("price_minor").alias("p"), F.when(F.col("quantity") == 3, "ended").otherwise(F.col("status")).alias("s"))
    b = l.where("work_id % 300 = 1").select(F.concat("listing_id", F.lit("x")), "edition_id", "price_minor", "status")
    e = T.editions(spark, d).select(F.col("edition_id").alias("e_id"), "edition_status")
    df = a.union(b).join(l, F.col("id") == F.col("listing_id"), "left").join(e, F.col("edition_id") == F.col("e_id"), "left")
    found = F.col("listing_id").isNotNull()
    differs = ~F.struct("want", "p").eqNullSafe(F.struct(F.col("edition_id").alias("want"), F.col("price_minor").alias("p")))
    return df.agg(
        F.count("*").alias("expected"), F.count("listing_id").alias("found"), F.count_if(~found).alias("missing"), F.count_if(found & ~F.col("status").eqNullSafe(F.col("s"))).alias("status_differs"),
        F.count_if(found & differs).alias("link_differs"), F.count_if(F.col("edition_status") == "superseded").alias("superseded"),
    )


@query(f"""{with_tables("credits")}, c AS (SELECT DISTINCT work_id, person_id FROM credits), n AS (SELECT person_id, count(*) AS n FROM c GROUP BY person_id)
SELECT a.person_id AS a, b.person_id AS b, count(*) AS shared, max(x.n) AS n_a, max(y.n) AS n_b FROM c a JOIN c b ON a.work_id = b.work_id AND a.person_id < b.person_id
JOIN n x ON x.person_id = a.person_id JOIN n y ON y.person_id = b.person_id GROUP BY a.person_id, b.person_id HAVING count(*) >= 2""")
def duplicate_people_pairs(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """People who share at least two works, with how many each has.

    Pairs are counted work by work, but for works of more than CROWD people, which would make too many. Two people who share only
    such works share one without the largest of each, so no one is paired on that; shared crowds are counted for the pairs found.
    """
    scratch = Scratch(spark)
    c = T.credits(spark, d).where(only).select("work_id", "person_id").distinct()
    c = scratch.put(c.join(c.groupBy("work_id").agg(F.count("*").alias("size")), "work_id"), "credits")
    pairs = lambda k: k.select("work_id", F.col("person_id").alias("a")).join(k.select("work_id", F.col("person_id").alias("b")), "work_id").where("a < b").select("a", "b")
    crowds = c.where(F.col("size") > CROWD)
    p = pairs(c.where(F.col("size") <= CROWD)).withColumn("k", F.lit(1))
    crowded = not crowds.isEmpty()
    if crowded:
        largest = Window.partitionBy("person_id").orderBy(F.desc("size"), "work_id")
        p = p.union(pairs(crowds.withColumn("place", F.row_number().over(largest)).where("place > 1")).withColumn("k", F.lit(0)))
    # Few pairs come twice, so they are dealt out before they are counted.
    p = p.repartition("a", "b").groupBy("a", "b").agg(F.sum("k").alias("shared"))
    if crowded:
        works = crowds.groupBy("person_id").agg(F.collect_list("work_id").alias("w"))
        p = p.join(works.toDF("a", "wa"), "a", "left").join(works.toDF("b", "wb"), "b", "left")
        p = p.withColumn("shared", F.col("shared") + F.coalesce(F.array_size(F.array_intersect("wa", "wb")), F.lit(0)))
    n = c.groupBy("person_id").agg(F.count("*").alias("n"))
    p = p.where("shared >= 2").join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    return p.select("a", "b", "shared", "n_a", "n_b")


@query(f"""{with_tables("credits")}, s AS (SELECT person_id, string_agg(DISTINCT work_id, ',' ORDER BY work_id) AS works, count(DISTINCT work_id) AS n FROM credits WHERE role = 'cover_model' GROUP BY person_id)
SELECT works, n, count(*) AS people, min(person_id) AS first_person FROM s WHERE n >= 2 GROUP BY works, n HAVING count(*) >= 2""")
def identical_work_sets(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """People whose work sets are the same: grouped by the set, not compared in pairs."""
    c = T.credits(spark, d).where("role = 'cover_model'").where(only)
    s = c.groupBy("person_id").agg(F.array_sort(F.collect_set("work_id")).alias("w")).select("person_id", F.size("w").cast("long").alias("n"), F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("works"))
    return s.where("n >= 2").groupBy("works", "n").agg(F.count("*").alias("people"), F.min("person_id").alias("first_person")).where("people >= 2")


@query(f"""{with_tables("credits", "people")} SELECT person_id, name, count(DISTINCT work_id) AS works FROM credits JOIN people USING (person_id) GROUP BY person_id, name ORDER BY works DESC, person_id LIMIT 15""")
def top_people(spark: SparkSession, d: str) -> DataFrame:
    n = T.credits(spark, d).groupBy("person_id").agg(F.countDistinct("work_id").alias("works")).orderBy(F.desc("works"), "person_id").limit(15)
    return n.join(T.people(spark, d).select("person_id", "name"), "person_id").select("person_id", "name", "works").orderBy(F.desc("works"), "person_id")


@query(f"""{with_tables("works", "credits")} SELECT work_id, title FROM works w WHERE NOT EXISTS (SELECT 1 FROM credits c WHERE c.work_id = w.work_id AND role = 'featured')""")
def orphan_works(spark: SparkSession, d: str) -> DataFrame:
    return T.works(spark, d).join(T.credits(spark, d).where("role = 'featured'").select("work_id"), "work_id", "left_anti").select("work_id", "title")


@query(f"""{with_tables("listings")}, o AS (SELECT work_id, currency, status, price_minor, row_number() OVER (PARTITION BY work_id ORDER BY observed_at DESC, listing_id) AS pos FROM listings),
m AS (SELECT work_id, currency FROM (SELECT work_id, currency, count(*) AS n, min(pos) AS p FROM o GROUP BY work_id, currency) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY n DESC, p) = 1)
SELECT work_id, currency, min(price_minor) FILTER (WHERE status = 'active') AS low, min(price_minor) FILTER (WHERE status = 'completed') AS sold_low, max(price_minor) FILTER (WHERE status = 'completed') AS sold_high,
  quantile_disc(price_minor, 0.5) FILTER (WHERE status = 'completed') AS sold_median, count(*) AS offers FROM o JOIN m USING (work_id, currency) GROUP BY work_id, currency""")
def price_answers(spark: SparkSession, d: str) -> DataFrame:
    """Prices in a book's leading currency: the most frequent, the first seen of equals; the median is the lower one."""
    o = T.listings(spark, d).select("work_id", "currency", "status", "price_minor", F.row_number().over(Window.partitionBy("work_id").orderBy(F.desc("observed_at"), "listing_id")).alias("pos"))
    lead = o.groupBy("work_id", "currency").agg(F.count("*").alias("n"), F.min("pos").alias("p")).groupBy("work_id").agg(F.max_by("currency", F.struct("n", -F.col("p"))).alias("currency"))
    active, sold = (F.when(F.col("status") == s, F.col("price_minor")) for s in ("active", "completed"))
    return o.join(lead, ["work_id", "currency"]).groupBy("work_id", "currency").agg(
        F.min(active).alias("low"), F.min(sold).alias("sold_low"), F.max(sold).alias("sold_high"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN status = 'completed' THEN price_minor END)").cast("long").alias("sold_median"), F.count("*").alias("offers"),
    )


@query(f"""{with_tables("listings", "works")}, k AS (SELECT l.*, CASE WHEN edition_id IS NOT NULL THEN 'work:' || work_id WHEN quantity > 5 THEN l.format || ':title:' || lower(w.title) ELSE listing_id END AS key FROM listings l JOIN works w USING (work_id))
SELECT key, count(*) AS offers, count(DISTINCT source_id) AS sources, arg_min(listing_id, (CASE status WHEN 'active' THEN 0 WHEN 'unknown' THEN 1 WHEN 'completed' THEN 2 ELSE 3 END, listing_id)) AS primary_listing FROM k GROUP BY key""")
def offer_groups(spark: SparkSession, d: str) -> DataFrame:
    """Offers of one work, or of one format and title, or alone; the group shows its best-standing listing."""
    l = T.listings(spark, d).join(T.works(spark, d).select("work_id", "title"), "work_id")
    key = F.when(F.col("edition_id").isNotNull(), F.concat(F.lit("work:"), F.col("work_id").cast("string"))).when(F.col("quantity") > 5, F.concat("format", F.lit(":title:"), F.lower("title"))).otherwise(F.col("listing_id"))
    return l.groupBy(key.alias("key")).agg(F.count("*").alias("offers"), F.countDistinct("source_id").alias("sources"), F.min_by("listing_id", F.struct(offers.status_rank(F.col("status")), "listing_id")).alias("primary_listing"))


@query(f"""{with_tables("listings")} SELECT source_name, count(*) AS offers, min(price_minor) AS low, row_number() OVER (ORDER BY source_name) AS place FROM listings WHERE status = 'active' GROUP BY source_name""")
def platform_groups(spark: SparkSession, d: str) -> DataFrame:
    """Offers by platform, in the order in which readers sort names. As many rows as sources."""
    g = T.listings(spark, d).where("status = 'active'").groupBy("source_name").agg(F.count("*").alias("offers"), F.min("price_minor").alias("low"))
    return ordinals.numbered(g.withColumn("sorted", F.collate("source_name", "UNICODE_CI")), ["sorted", "source_name"], "place").drop("sorted")


@query(f"""{with_tables("editions", "listings")} SELECT e.edition_id, e.format FROM editions e WHERE edition_status = 'published' AND EXISTS (
  SELECT 1 FROM listings l WHERE l.work_id = e.work_id AND l.status <> 'excluded' AND (l.format = e.format OR (l.format = '' AND (l.currency = 'JPY') = (e.format = 'digital'))) AND l.price_minor < 200000)""")
def visible_editions(spark: SparkSession, d: str) -> DataFrame:
    """Published editions that some fitting, cheap listing offers."""
    l = T.listings(spark, d).where("price_minor < 200000").select(F.col("work_id").alias("w"), F.col("format").alias("f"), "status", F.when(F.col("currency") == "JPY", "digital").otherwise("fixed").alias("price_type"))
    fits = offers.listing_fits_edition(F.col("f"), F.col("format"), F.col("price_type"), F.col("status"))
    return T.editions(spark, d).where("edition_status = 'published'").join(l, (F.col("work_id") == F.col("w")) & fits, "left_semi").select("edition_id", "format")


@query(f"""{with_tables("editions", "works", "credits")}, c AS (SELECT DISTINCT person_id, work_id FROM credits)
SELECT person_id, count(DISTINCT e.edition_id) AS editions, count(DISTINCT e.work_id) AS works, count(DISTINCT e.edition_id) FILTER (WHERE e.isbn = '') AS no_isbn,
  count(DISTINCT e.edition_id) FILTER (WHERE e.publication_date IS NULL AND e.format = 'physical') AS no_date, min(year(publication_date)) AS first_year, max(year(publication_date)) AS last_year
FROM c JOIN editions e USING (work_id) GROUP BY person_id""")
def model_coverage(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Counts and gaps per credited person, and the span of years."""
    c = T.credits(spark, d).where(only).select("person_id", "work_id").distinct()
    e = F.col("edition_id")
    return c.join(T.editions(spark, d), "work_id").groupBy("person_id").agg(
        F.countDistinct("edition_id").alias("editions"), F.countDistinct("work_id").alias("works"), F.countDistinct(F.when(F.col("isbn") == "", e)).alias("no_isbn"),
        F.countDistinct(F.when(F.col("publication_date").isNull() & (F.col("format") == "physical"), e)).alias("no_date"), F.min(F.year("publication_date")).alias("first_year"), F.max(F.year("publication_date")).alias("last_year"),
    )


@query(f"""{with_tables("editions")}, g AS (SELECT format, list_filter([CASE WHEN isbn = '' THEN 'isbn' END, CASE WHEN publication_date IS NULL THEN 'publication' END, CASE WHEN format = 'digital' AND store_date IS NULL THEN 'store' END], lambda x: x IS NOT NULL) AS gaps FROM editions WHERE edition_status = 'published')
SELECT format, array_to_string(gaps, '+') AS gaps, count(*) AS n FROM g GROUP BY ALL""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Which facts editions lack, in combination."""
    gap = F.array_compact(F.array(F.when(F.col("isbn") == "", "isbn"), F.when(F.col("publication_date").isNull(), "publication"), F.when((F.col("format") == "digital") & F.col("store_date").isNull(), "store")))
    return T.editions(spark, d).where("edition_status = 'published'").groupBy("format", F.array_join(gap, "+").alias("gaps")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("listings")} SELECT source_id, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'ended') AS ended, count(*) FILTER (WHERE status = 'completed') AS completed FROM listings GROUP BY source_id""")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.listings(spark, d).groupBy("source_id").pivot("status", ["active", "ended", "completed"]).count().na.fill(0)


@query(f"""{with_tables("works")} SELECT publisher, lower(trim(publisher)) AS canonical, 'company-' || sha256(lower(trim(lower(trim(publisher))))) AS slug, count(*) AS works FROM works GROUP BY ALL""")
def publisher_report(spark: SparkSession, d: str) -> DataFrame:
    """Names are made canonical before they are hashed."""
    from bindery.functions import ids

    canonical = texts.canonical_publisher(F.col("publisher"))
    return T.works(spark, d).groupBy("publisher", canonical.alias("canonical"), ids.slug("company", canonical).alias("slug")).agg(F.count("*").alias("works"))


@query(f"""{with_tables("works")}, t AS (SELECT CASE WHEN work_id % 3 = 0 THEN title || ' [line ' || (work_id % 8) || ']' ELSE title END AS t FROM works)
SELECT nullif(regexp_extract(t, '[\\[(]([^\\])]+)[\\])]\\s*$', 1), '') AS series, count(*) AS n, min(trim(regexp_replace(t, '\\s*[\\[(][^\\])]+[\\])]\\s*$', ''))) AS sample FROM t GROUP BY 1""")
def series_ranking(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("work_id") % 3 == 0, F.concat("title", F.lit(" [line "), (F.col("work_id") % 8).cast("string"), F.lit("]"))).otherwise(F.col("title"))
    df = T.works(spark, d).select(t.alias("t"))
    return df.groupBy(texts.series_name(F.col("t")).alias("series")).agg(F.count("*").alias("n"), F.min(texts.without_series(F.col("t"))).alias("sample"))


@query(f"""{with_tables("listings", "works")} SELECT listing_id, CASE currency WHEN 'JPY' THEN 'JPY ' || CAST(price_minor AS VARCHAR) ELSE currency || ' ' || CAST(price_minor // 100 AS VARCHAR) || '.' || lpad(CAST(price_minor % 100 AS VARCHAR), 2, '0') END AS label FROM listings""")
def price_labels(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    p = F.col("price_minor")
    cents = F.concat(F.floor(p / 100).cast("string"), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0"))
    whole = F.col("currency").isin(*offers.WHOLE_CURRENCIES)
    return T.listings(spark, d).where(only).select("listing_id", F.concat("currency", F.lit(" "), F.when(whole, p.cast("string")).otherwise(cents)).alias("label"))


@query(f"""{with_tables("editions", "works")}, n AS (SELECT publisher, title, count(*) AS k, min(work_id) AS pos FROM works GROUP BY publisher, title)
SELECT publisher, string_agg(title, ', ' ORDER BY k DESC, pos) AS names FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY k DESC, pos) <= 3) GROUP BY publisher""")
def top_names(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent titles of a publisher, the first seen of equals."""
    n = T.works(spark, d).groupBy("publisher", "title").agg(F.count("*").alias("k"), F.min("work_id").alias("pos"))
    n = n.withColumn("place", F.row_number().over(Window.partitionBy("publisher").orderBy(F.desc("k"), "pos"))).where("place <= 3")
    best = F.array_sort(F.collect_list(F.struct("place", "title")))
    return n.groupBy("publisher").agg(F.array_join(F.transform(best, lambda x: x["title"]), ", ").alias("names"))


@query(f"""{with_tables("credits", "works", "people")}, c AS (SELECT DISTINCT person_id, work_id FROM credits)
SELECT person_id, name, string_agg(title || ' (' || publisher || ')', '; ' ORDER BY c.work_id) AS bibliography FROM c JOIN works USING (work_id) JOIN people USING (person_id) GROUP BY person_id, name""")
def bibliography_export(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    c = T.credits(spark, d).where(only).select("person_id", "work_id").distinct().join(T.works(spark, d), "work_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("work_id", F.concat("title", F.lit(" ("), "publisher", F.lit(")")).alias("line")))), lambda x: x["line"])
    return c.groupBy("person_id").agg(F.array_join(lines, "; ").alias("bibliography")).join(T.people(spark, d).select("person_id", "name"), "person_id").select("person_id", "name", "bibliography")


@query(f"""{with_tables("people", "credits")}, a AS (SELECT DISTINCT CASE WHEN person_id % 50 < 25 THEN person_id - person_id % 2 ELSE person_id END AS person_id, work_id FROM credits)
SELECT person_id, count(*) AS works FROM a GROUP BY person_id ORDER BY works DESC, person_id LIMIT 20""")
def ranked_models(spark: SparkSession, d: str) -> DataFrame:
    """Ranking after duplicate people are folded."""
    p = F.col("person_id")
    folded = F.when(p % 50 < 25, p - p % 2).otherwise(p)
    return T.credits(spark, d).select(folded.alias("person_id"), "work_id").distinct().groupBy("person_id").agg(F.count("*").alias("works")).orderBy(F.desc("works"), "person_id").limit(20)


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"#]+)"', 1)) AS links, len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"#]+)"', 1))) AS different,
  nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title FROM pages""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and title of raw pages, without leaving the JVM."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"#]+)"'), F.lit(1))
    return T.table(spark, d, "pages").select(
        "page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("different"), F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit("")).alias("title")
    )


@query("""WITH j AS (SELECT '[' || string_agg('{"id":' || s_suppkey || ',"name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']' AS doc FROM supplier)
SELECT CAST(json_extract_string(x, '$.id') AS BIGINT) AS id, json_extract_string(x, '$.name') AS name FROM (SELECT unnest(CAST(doc AS JSON[])) AS x FROM j)""")
def recordset_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Record sets passed as JSON parameters of a thousand ids each at most."""
    doc = T.table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000)).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))).alias("doc"))
    return doc.select(F.inline(F.from_json("doc", "array<struct<id:bigint,name:string>>")))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(round(CAST(value AS DECIMAL(18,4)) * 100, 0)) AS BIGINT) AS total FROM events GROUP BY ALL""")
def daily_event_totals(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling daily windows."""
    e = T.table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value").cast("decimal(18,4)") * 100, 0)).cast("long").alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: session windows that close after six idle hours."""
    e = T.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


@query(f"""{with_tables("works")} SELECT work_id, row_number() OVER (PARTITION BY publisher ORDER BY title, work_id) AS place, row_number() OVER (ORDER BY publisher, title, work_id) AS overall FROM works""")
def running_ordinals(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Numbers within each group, and through all of them: group sizes are summed first, so the overall number needs no global sort of rows."""
    w = T.works(spark, d).where(only)
    sizes = w.groupBy("publisher").agg(F.count("*").alias("n"))
    before = ordinals.running(sizes, ["publisher"], "n", "before").select("publisher", "before")
    df = w.join(before, "publisher").withColumn("place", F.row_number().over(Window.partitionBy("publisher").orderBy("title", "work_id")))
    return df.select("work_id", F.col("place"), (F.col("before") + F.col("place")).alias("overall"))


@query(f"""{with_tables("works", "editions", "listings")}, i AS (SELECT DISTINCT w.work_id, lower(title) AS q FROM works w WHERE work_status = 'published'),
r AS (SELECT lower(title) AS q, w.work_id, e.format FROM listings l JOIN editions e ON e.edition_id = l.edition_id JOIN works w ON w.work_id = e.work_id WHERE w.work_status = 'published')
SELECT q, count(DISTINCT i.work_id) AS expected, count(DISTINCT r.work_id) AS searchable FROM i LEFT JOIN r USING (q) GROUP BY q""")
def homepage_verification(spark: SparkSession, d: str) -> DataFrame:
    """Works expected under an exact name against those that offers lead to. Counted apart, so the two sides don't multiply."""
    w = T.works(spark, d).where("work_status = 'published'").select("work_id", F.lower("title").alias("q"))
    expected = w.groupBy("q").agg(F.countDistinct("work_id").alias("expected"))
    e = T.editions(spark, d).select("edition_id", "work_id")
    l = T.listings(spark, d).select("edition_id").join(e, "edition_id").join(w, "work_id").groupBy("q").agg(F.countDistinct("work_id").alias("searchable"))
    return expected.join(l, "q", "left").select("q", "expected", F.coalesce("searchable", F.lit(0)).alias("searchable"))


@query()
def nfkc_keys(spark: SparkSession, d: str) -> DataFrame:
    """Name keys in compatibility form; SQL has no such form, tests compare it with the standard library."""
    t = T.table(spark, d, "documents")
    return t.select("doc_id", "text").mapInArrow(texts.name_keys, f"doc_id {dict(t.dtypes)['doc_id']}, key string, spaced string, width int")
