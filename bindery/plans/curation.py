"""Reviewed corrections, merges and row rules over the catalog's stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import extract, offers
from bindery.operators import permissions
from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry, with_tables

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)


@query(f"""{with_tables("editions", "works")}, r AS (
  SELECT 'no_isbn' AS rule, edition_id AS id FROM editions WHERE isbn = '' UNION ALL SELECT 'digital_without_store_date', edition_id FROM editions WHERE format = 'digital' AND store_date IS NULL
  UNION ALL SELECT 'issue_without_month', e.edition_id FROM editions e JOIN works w USING (work_id) WHERE publication_type = 'magazine_issue' AND NOT regexp_matches(issue_month, '^[0-9]{{4}}-(0[1-9]|1[0-2])$')
  UNION ALL SELECT 'date_in_future', edition_id FROM editions WHERE publication_date > DATE '2019-01-01')
SELECT rule, count(*) AS violations, min(id) AS sample FROM r GROUP BY rule""")
def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    """Named expectations, each row with all that it breaks, in one pass."""
    e = T.editions(spark, d).join(T.works(spark, d).select("work_id", "publication_type", "issue_month"), "work_id")
    rules = {
        "no_isbn": F.col("isbn") == "", "digital_without_store_date": (F.col("format") == "digital") & F.col("store_date").isNull(),
        "issue_without_month": (F.col("publication_type") == "magazine_issue") & ~F.col("issue_month").rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"),
        "date_in_future": F.col("publication_date") > F.lit("2019-01-01").cast("date"),
    }
    broken = F.array_compact(F.array(*(F.when(p, F.lit(name)) for name, p in rules.items())))
    return e.select("edition_id", F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("violations"), F.min("edition_id").alias("sample"))


@query(f"""{with_tables("observations")}, r AS (SELECT thread, 'negative_price' AS issue FROM observations WHERE price_minor < 0 UNION ALL SELECT thread, 'odd_quantity' FROM observations WHERE quantity >= 49
  UNION ALL SELECT thread, 'repeated_line' FROM observations GROUP BY thread, line HAVING count(*) > 1 UNION ALL SELECT thread, 'mixed_currency' FROM observations GROUP BY thread HAVING count(DISTINCT currency) > 2)
SELECT issue, count(*) AS n, count(DISTINCT thread) AS threads FROM r GROUP BY issue""")
def capture_audit(spark: SparkSession, d: str) -> DataFrame:
    """Row rules and rules across rows."""
    o = T.observations(spark, d)
    issue = lambda df, name: df.select("thread", F.lit(name).alias("issue"))
    found = issue(o.where("price_minor < 0"), "negative_price").unionByName(issue(o.where("quantity >= 49"), "odd_quantity"))
    found = found.unionByName(issue(o.groupBy("thread", "line").count().where("count > 1"), "repeated_line"))
    found = found.unionByName(issue(o.groupBy("thread").agg(F.countDistinct("currency").alias("c")).where("c > 2"), "mixed_currency"))
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("thread").alias("threads"))


@query(f"""{with_tables("jobs", "sources")} SELECT CASE WHEN s.source_id IS NULL THEN 'unknown_source' WHEN NOT enabled THEN 'disabled_source' WHEN kind = 'digital_store' AND priority <= 2 THEN 'sold_of_digital'
  WHEN attempt > 6 THEN 'attempts' ELSE 'ok' END AS verdict, count(*) AS n FROM jobs LEFT JOIN sources s ON s.source_id = jobs.source_id GROUP BY 1""")
def job_policy(spark: SparkSession, d: str) -> DataFrame:
    """Whether a job may run for its source; urgent ones stand in for searches of sales."""
    s = T.sources(spark, d).select(F.col("source_id").alias("s"), "enabled", "kind")
    verdict = (
        F.when(F.col("s").isNull(), "unknown_source").when(~F.col("enabled"), "disabled_source")
        .when((F.col("kind") == "digital_store") & (F.col("priority") <= 2), "sold_of_digital").when(F.col("attempt") > 6, "attempts").otherwise("ok")
    )
    return T.jobs(spark, d).join(s, F.col("source_id") == F.col("s"), "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("works", "editions")} SELECT work_id, max(publication_date) AS newest FROM editions JOIN works USING (work_id) WHERE work_status = 'published' AND publication_date IS NOT NULL
GROUP BY work_id ORDER BY newest DESC, work_id LIMIT 10""")
def newest_works(spark: SparkSession, d: str) -> DataFrame:
    e = T.editions(spark, d).where("publication_date IS NOT NULL").join(T.works(spark, d).where("work_status = 'published'").select("work_id"), "work_id")
    return e.groupBy("work_id").agg(F.max("publication_date").alias("newest")).orderBy(F.desc("newest"), "work_id").limit(10)


@query(f"""{with_tables("works")} SELECT work_id, title, row_number() OVER (PARTITION BY publisher ORDER BY title ILIKE '%small%' DESC, size > 20 DESC, work_id) AS place FROM works QUALIFY place <= 3""")
def relevance_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each publisher, those with the name first, then those with a strong signal."""
    w = Window.partitionBy("publisher").orderBy(F.col("title").ilike("%small%").desc(), (F.col("size") > 20).desc(), "work_id")
    return T.works(spark, d).select("work_id", "title", F.row_number().over(w).alias("place")).where("place <= 3")


@query(f"""{with_tables("observations")}, o AS (SELECT *, CASE quantity % 4 WHEN 0 THEN 'used_asking' WHEN 1 THEN 'completed_sale' ELSE '' END AS basis FROM observations)
SELECT CASE WHEN basis <> '' OR status = 'completed' THEN 'used_prices' ELSE 'current_prices' END AS scope, CASE WHEN basis <> '' THEN 'basis,' ELSE '' END || 'price,status' AS fields, count(*) AS n FROM o GROUP BY ALL""")
def permission_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The grant and the fields that each observation needs."""
    basis = F.when(F.col("quantity") % 4 == 0, "used_asking").when(F.col("quantity") % 4 == 1, "completed_sale").otherwise("")
    o = T.observations(spark, d).withColumn("basis", basis)
    none = F.expr("cast(array() as array<struct<basis:string>>)")
    scope = permissions.observation_scope(F.col("status"), F.col("basis"), F.col("price_minor"), none)
    fields = F.array_join(permissions.observation_fields({"price": "price_minor", "status": "status", "basis": "basis"}), ",")
    return o.groupBy(scope.alias("scope"), fields.alias("fields")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("editions")}, p AS (SELECT edition_id, CAST(publication_date AS TIMESTAMP) AS v, CASE edition_id % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 2 THEN 'day' ELSE '' END AS precision,
  CASE WHEN edition_id % 5 = 0 THEN '' ELSE 'https://a.example/' END AS url FROM editions)
SELECT edition_id, CASE precision WHEN 'month' THEN date_trunc('month', v) WHEN 'year' THEN date_trunc('year', v) ELSE date_trunc('day', v) END AS day,
  CASE WHEN v IS NULL AND (precision <> '' OR url <> '') THEN 'date_missing' WHEN v IS NOT NULL AND (precision = '' OR url = '') THEN 'source_missing' END AS problem FROM p""")
def sourced_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates cut to their precision, and those that lack a date or a source."""
    k = F.col("edition_id")
    precision = F.when(k % 4 == 0, "month").when(k % 4 == 1, "year").when(k % 4 == 2, "day").otherwise("")
    e = T.editions(spark, d).select(k, F.col("publication_date").cast("timestamp").alias("v"), precision.alias("precision"), F.when(k % 5 == 0, "").otherwise("https://a.example/").alias("url"))
    return e.select("edition_id", offers.partial_date(F.col("v"), F.col("precision")).cast("timestamp_ntz").alias("day"), offers.sourced_date_problem(F.col("v"), F.col("precision"), F.col("url")).alias("problem"))


@query(f"""{with_tables("works", "editions", "credits")}, m AS (SELECT work_id AS member, min(work_id) OVER (PARTITION BY title, publisher) AS canonical FROM works WHERE work_status = 'published'),
c AS (SELECT canonical, count(DISTINCT person_id) AS people FROM credits JOIN m ON member = work_id GROUP BY canonical)
SELECT m.canonical, count(DISTINCT member) AS members, count(edition_id) AS editions, max(coalesce(people, 0)) AS people FROM m JOIN editions e ON e.work_id = member LEFT JOIN c USING (canonical) GROUP BY m.canonical HAVING count(DISTINCT member) > 1""")
def work_merge(spark: SparkSession, d: str) -> DataFrame:
    """Works of one title and publisher fold into the first; editions move and credits unite."""
    w = T.works(spark, d).where("work_status = 'published'")
    canonical = w.groupBy("title", "publisher").agg(F.min("work_id").alias("canonical"))
    m = w.join(canonical, ["title", "publisher"]).select(F.col("work_id").alias("member"), "canonical")
    c = T.credits(spark, d).join(m, F.col("work_id") == F.col("member")).groupBy("canonical").agg(F.countDistinct("person_id").alias("people"))
    e = m.join(T.editions(spark, d), F.col("work_id") == F.col("member")).groupBy("canonical").agg(F.countDistinct("member").alias("members"), F.count("edition_id").alias("editions"))
    return e.where("members > 1").join(c, "canonical", "left").select("canonical", "members", "editions", F.coalesce("people", F.lit(0)).alias("people"))


@query(f"""{with_tables("works")}, fix(title, was, becomes) AS (VALUES ('small ring', 'Brand#11', 'Brand#X'), ('old bolt', 'Brand#12', 'Brand#Y'))
SELECT coalesce(becomes, publisher) AS publisher, count(*) AS n, count(becomes) AS corrected FROM works w LEFT JOIN fix ON fix.title = w.title AND was = publisher GROUP BY 1""")
def reviewed_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Exact corrections apply only where title and old value both fit."""
    fix = F.broadcast(spark.createDataFrame([("small ring", "Brand#11", "Brand#X"), ("old bolt", "Brand#12", "Brand#Y")], "title string, publisher string, becomes string"))
    df = T.works(spark, d).join(fix, ["title", "publisher"], "left")
    return df.groupBy(F.coalesce("becomes", "publisher").alias("publisher")).agg(F.count("*").alias("n"), F.count("becomes").alias("corrected"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3}-[0-9]{4}') AS found FROM documents)
SELECT doc_id, CASE WHEN len(list_distinct(found)) = 1 THEN found[1] END AS only_one, len(found) AS n FROM t WHERE len(found) > 0""")
def unique_date_rule(spark: SparkSession, d: str) -> DataFrame:
    """A figure counts as evidence only if the text states one such figure, however often."""
    t = T.table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3}-[0-9]{4}"), F.lit(0)).alias("found"))
    t = t.where(F.size("found") > 0)
    return t.select("doc_id", F.when(F.size(F.array_distinct("found")) == 1, F.element_at("found", 1)).alias("only_one"), F.size("found").cast("long").alias("n"))


@query(f"""{with_tables("works", "listings", "people", "credits")}, s AS (
  SELECT 'works' AS part, count(*) AS n FROM works UNION ALL SELECT 'listings', count(*) FROM listings WHERE work_id IN (SELECT work_id FROM works)
  UNION ALL SELECT 'people', count(*) FROM people WHERE person_id IN (SELECT person_id FROM credits) UNION ALL SELECT 'credits', count(*) FROM credits)
SELECT * FROM s""")
def work_snapshot(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Sizes of all that hangs on a set of works."""
    w = T.works(spark, d).where(only).select("work_id")
    c = T.credits(spark, d).join(w, "work_id", "left_semi")
    parts = {"works": w, "listings": T.listings(spark, d).join(w, "work_id", "left_semi"), "people": T.people(spark, d).join(c, "person_id", "left_semi"), "credits": c}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""{with_tables("listings", "works")} SELECT listing_id, title || ' by ' || publisher || CASE WHEN price_minor > 0 THEN ', ' || status || ' at ' || currency || ' ' || price_minor ELSE '' END AS summary FROM listings JOIN works USING (work_id)""")
def fact_summaries(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    df = T.listings(spark, d).where(only).join(T.works(spark, d), "work_id")
    price = F.when(F.col("price_minor") > 0, F.concat(F.lit(", "), "status", F.lit(" at "), "currency", F.lit(" "), F.col("price_minor").cast("string"))).otherwise("")
    return df.select("listing_id", F.concat("title", F.lit(" by "), "publisher", price).alias("summary"))


@query()
def title_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How works' titles relate to the names of their people; script-aware, so tests check the rule itself."""
    t = T.works(spark, d).select("work_id", "title", F.array(F.element_at(F.split("title", " "), -1), F.lit("old bolt")).alias("names"))
    return t.groupBy(extract.classify_title("title", "names")["cls"].alias("cls")).agg(F.count("*").alias("n"))


@query()
def page_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices and states that raw pages give away."""
    p = T.table(spark, d, "pages")
    price = extract.parsed_price(F.col("html"), F.lit(""), F.lit(""), F.lit("JP"))
    return p.select("page_id", price["price_minor"].alias("price_minor"), price["currency"].alias("currency"), extract.evident_status(F.col("html"), F.lit("active_discovery"))["status"].alias("status"))
