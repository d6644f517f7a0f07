"""Guards of ingestion and of reviewed corrections, and rules about titles, names and addresses, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import ids, rules, texts
from bindery.operators.intervals import interval_join, merged
from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry, with_tables

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)
_pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))


def _sql_pick(k: str, *v: str) -> str:
    return f"[{', '.join(repr(x) for x in v)}][{k} % {len(v)} + 1]"


# --- ingestion ---------------------------------------------------------------------------------------------------


@query(f"""{with_tables("observations", "sources", "editions")},
o AS (SELECT thread, line, work_id, price_minor, quantity, source_format AS format, CASE WHEN quantity % 4 = 0 THEN work_id * 2 + quantity % 8 // 4 END AS explicit,
  CASE WHEN quantity % 3 = 0 THEN '' ELSE 'list' END AS basis, kind = 'auction' AS strict_source FROM observations JOIN sources USING (source_id)),
s AS (SELECT thread, arg_min(format, (line, work_id, price_minor, quantity)) AS s_format, arg_min(work_id * 2 + CAST(format = 'digital' AS INT), (line, work_id, price_minor, quantity)) AS s_edition FROM o GROUP BY thread),
j AS (SELECT o.*, s_format, coalesce(explicit, s_edition) AS link, e.format AS e_format, e.work_id % 5 = 4 AS strict_work FROM o JOIN s USING (thread) LEFT JOIN editions e ON e.edition_id = coalesce(explicit, s_edition)),
v AS (SELECT *, e_format IS NOT NULL AND e_format = format AS fits, CASE WHEN s_format <> format THEN 'format_changed' WHEN explicit IS NOT NULL AND NOT (e_format IS NOT NULL AND e_format = format) THEN 'edition_format'
  WHEN (strict_source OR (e_format IS NOT NULL AND e_format = format AND strict_work)) AND price_minor > 0 AND basis = '' THEN 'price_basis' ELSE 'accepted' END AS verdict FROM j)
SELECT verdict, count(*) AS n, count(CASE WHEN fits THEN link END) AS linked FROM v GROUP BY verdict""")
def ingest_state_guards(spark: SparkSession, d: str) -> DataFrame:
    """What stored state allows: a listing keeps its format; an edition it is sent with must have that format, one it
    inherits is dropped instead; strict sources and works need a basis for a price."""
    s = T.sources(spark, d).select("source_id", F.col("source_format").alias("format"), (F.col("kind") == "auction").alias("strict_source"))
    q = F.col("quantity")
    o = T.observations(spark, d).join(s, "source_id").withColumn("explicit", F.when(q % 4 == 0, F.col("work_id") * 2 + F.floor(q % 8 / 4)))
    o = o.withColumn("basis", F.when(q % 3 == 0, "").otherwise("list"))
    first = F.min(F.struct("line", "work_id", "price_minor", "quantity", "format", (F.col("work_id") * 2 + (F.col("format") == "digital").cast("int")).alias("edition"))).alias("f")
    stored = o.groupBy("thread").agg(first).select("thread", F.col("f.format").alias("s_format"), F.col("f.edition").alias("s_edition"))
    o = o.join(stored, "thread").withColumn("link", F.coalesce("explicit", "s_edition"))
    e = T.editions(spark, d).select(F.col("edition_id").alias("link"), F.col("format").alias("e_format"), (F.col("work_id") % 5 == 4).alias("strict_work"))
    o = o.join(e, "link", "left").withColumn("fits", F.coalesce(F.col("e_format") == F.col("format"), F.lit(False)))
    strict = F.col("strict_source") | (F.col("fits") & F.col("strict_work"))
    verdict = (
        F.when(F.col("s_format") != F.col("format"), "format_changed").when(F.col("explicit").isNotNull() & ~F.col("fits"), "edition_format")
        .when(strict & (F.col("price_minor") > 0) & (F.col("basis") == ""), "price_basis").otherwise("accepted")
    )
    return o.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.count(F.when(F.col("fits"), F.col("link"))).alias("linked"))


@query(f"""{with_tables("jobs")}, j AS (SELECT {_sql_pick("job_id", "catalog_discovery", "active_discovery", " Listing_Detail", "sold_discovery", "unknown")} AS operation FROM jobs)
SELECT CASE lower(trim(operation)) WHEN 'catalog_discovery' THEN 'bibliography' WHEN 'active_discovery' THEN 'current_prices' WHEN 'listing_detail' THEN 'current_prices' WHEN 'sold_discovery' THEN 'used_prices' END AS scope,
  CASE lower(trim(operation)) WHEN 'catalog_discovery' THEN 3 WHEN 'active_discovery' THEN 7 WHEN 'listing_detail' THEN 7 WHEN 'sold_discovery' THEN 10 ELSE 0 END AS fields, count(*) AS n FROM j GROUP BY ALL""")
def operation_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The grant that each job's operation needs."""
    op = _pick(F.col("job_id"), "catalog_discovery", "active_discovery", " Listing_Detail", "sold_discovery", "unknown")
    needs = rules.operation_needs(op)
    return T.jobs(spark, d).groupBy(needs["scope"].alias("scope"), F.coalesce(F.size(F.filter(needs["fields"], lambda x: x.isNotNull())), F.lit(0)).alias("fields")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("observations")}, g AS (SELECT DISTINCT source_id, {_sql_pick("line", "title", "price", "currency")} AS field, source_id % 5 <> 0 AS live, DATE '1993-01-01' + CAST(line * 200 AS INT) AS from_day, DATE '1996-01-01' + CAST(line * 90 AS INT) AS to_day FROM observations),
n AS (SELECT source_id, CAST(observed_at AS DATE) AS day, count(*) AS n FROM observations GROUP BY ALL),
c AS (SELECT n.source_id, n.day, n.n, count(DISTINCT field) AS fields FROM n LEFT JOIN g ON g.source_id = n.source_id AND live AND from_day <= n.day AND n.day < to_day AND to_day > DATE '1996-06-01' GROUP BY ALL)
SELECT CASE WHEN fields >= 3 THEN 'covered' WHEN fields > 0 THEN 'some_fields' ELSE 'none' END AS coverage, count(*) AS captures, CAST(sum(n) AS BIGINT) AS observations FROM c GROUP BY 1""")
def grants_as_of_capture(spark: SparkSession, d: str) -> DataFrame:
    """Captures whose fields are granted both at the time of capture and now: spans joined on source and time."""
    o = T.observations(spark, d)
    day = lambda base, step: F.date_add(F.lit(base).cast("date"), (F.col("line") * step).cast("int"))
    g = o.select("source_id", _pick(F.col("line"), "title", "price", "currency").alias("field"), (F.col("source_id") % 5 != 0).alias("live"), day("1993-01-01", 200).alias("from_day"), day("1996-01-01", 90).alias("to_day")).distinct()
    g = g.where("live AND to_day > DATE '1996-06-01'")
    n = o.groupBy("source_id", F.col("observed_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    spans = merged(g, ["source_id", "field"], "from_day", "to_day")
    valid = interval_join(n, spans, ["source_id"], "day", "from_day", "to_day", 32 * 86_400).groupBy("source_id", "day").agg(F.count_distinct("field").alias("fields"))
    c = n.join(valid, ["source_id", "day"], "left").withColumn("fields", F.coalesce("fields", F.lit(0)))
    coverage = F.when(F.col("fields") >= 3, "covered").when(F.col("fields") > 0, "some_fields").otherwise("none")
    return c.groupBy(coverage.alias("coverage")).agg(F.count("*").alias("captures"), F.sum("n").cast("long").alias("observations"))


@query(r"""WITH m AS (SELECT page_id AS k, ['publisher_cover', 'publisher_sample_001', 'listing_image', 'poster'][page_id % 4 + 1] AS kind, ['', 'remote_display', 'display_and_copy', 'revoked', 'public'][page_id % 5 + 1] AS scope,
  CASE WHEN page_id % 7 = 0 THEN '' ELSE 'https://a.example/e' END AS evidence, CASE WHEN page_id % 6 = 0 THEN ' ' ELSE 'letter' END AS basis, page_id % 8 <> 0 AS reviewed, url AS original, CASE WHEN page_id % 3 = 0 THEN 'https://copy.example/' || page_id ELSE url END AS storage FROM pages),
p AS (SELECT CASE WHEN kind = 'poster' THEN 'kind' WHEN NOT regexp_matches(original, '^https://[^/\s]+/') OR NOT regexp_matches(storage, '^https://[^/\s]+/') THEN 'address' WHEN scope = 'public' THEN 'scope' WHEN scope = '' THEN 'ok'
  WHEN evidence = '' THEN 'evidence' WHEN trim(basis) = '' THEN 'basis' WHEN NOT reviewed THEN 'review' WHEN scope = 'remote_display' AND original <> storage THEN 'copied' ELSE 'ok' END AS problem FROM m)
SELECT problem, count(*) AS n FROM p GROUP BY problem""")
def media_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Pages stand in for pictures."""
    p, k = T.table(spark, d, "pages"), F.col("page_id")
    problem = rules.media_problem(
        _pick(k, "", "remote_display", "display_and_copy", "revoked", "public"), F.when(k % 7 == 0, "").otherwise("https://a.example/e"), F.when(k % 6 == 0, " ").otherwise("letter"),
        F.when(k % 8 != 0, F.lit("2024-01-01").cast("timestamp")), F.col("url"), F.when(k % 3 == 0, F.concat(F.lit("https://copy.example/"), k.cast("string"))).otherwise(F.col("url")),
        _pick(k, "publisher_cover", "publisher_sample_001", "listing_image", "poster"),
    )
    return p.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("works")}, x AS (SELECT work_id, {_sql_pick("work_id", *rules.EXCLUSIONS[:6], "too_old", "")} AS reason FROM works) SELECT reason, reason IN {rules.EXCLUSIONS} AS known, count(*) AS n FROM x GROUP BY ALL""")
def exclusion_reasons_known(spark: SparkSession, d: str) -> DataFrame:
    reason = _pick(F.col("work_id"), *rules.EXCLUSIONS[:6], "too_old", "")
    return T.works(spark, d).groupBy(reason.alias("reason"), reason.isin(*rules.EXCLUSIONS).alias("known")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("editions")}, e AS (SELECT *, 'https://' || {_sql_pick("edition_id", "store.example", "shop.example")} || '/1' AS offer, [NULL, 'https://store.example/2', 'https://press.example/3'][edition_id % 3 + 1] AS source FROM editions),
v AS (SELECT *, format = 'digital' AND (source IS NULL OR split_part(source, '/', 3) = split_part(offer, '/', 3)) AS own FROM e)
SELECT edition_id, CASE WHEN format = 'digital' THEN coalesce(store_date, release_date) ELSE store_date END AS store_date, CASE WHEN NOT own THEN publication_date END AS original_date, CASE WHEN own THEN 'original_unknown' END AS problem FROM v""")
def offer_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of digital offers, and whether the original publication's date has a source of its own."""
    k = F.col("edition_id")
    offer = F.concat(F.lit("https://"), _pick(k, "store.example", "shop.example"), F.lit("/1"))
    x = rules.offer_dates(F.col("format"), F.col("store_date"), F.col("release_date"), F.col("publication_date"), offer, _pick(k, None, "https://store.example/2", "https://press.example/3"))
    return T.editions(spark, d).select("edition_id", x.alias("x")).select("edition_id", "x.*")


# --- browsing ----------------------------------------------------------------------------------------------------


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS equal, count(*) FILTER (WHERE lang ILIKE '%E%') AS inside FROM documents GROUP BY lang""")
def language_filters(spark: SparkSession, d: str) -> DataFrame:
    """The two filters on languages: equal in one list, contained in the other."""
    return T.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("equal"), F.count_if(F.col("lang").ilike("%E%")).alias("inside"))


@query(f"""{with_tables("listings")} SELECT region, count(*) AS n FROM listings WHERE upper(region) IN (upper(trim(' france ')), upper(trim('Japan'))) GROUP BY region""")
def region_listings(spark: SparkSession, d: str) -> DataFrame:
    """Regions match whatever their case and the blanks around them."""
    wanted = [F.upper(F.trim(F.lit(x))) for x in (" france ", "Japan")]
    return T.listings(spark, d).where(F.upper("region").isin(*wanted)).groupBy("region").agg(F.count("*").alias("n"))


@query(f"""{with_tables("works", "credits", "people")}, n AS (SELECT work_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM credits JOIN people USING (person_id) WHERE role = 'featured' GROUP BY work_id)
SELECT w.work_id, coalesce(nullif(CASE WHEN w.work_id % 3 = 0 THEN '' WHEN w.work_id % 3 = 1 THEN 'given ' || title END, ''), names) AS featured FROM works w LEFT JOIN n USING (work_id)""")
def featured_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A work's own name list, or its credited people where it has none."""
    n = T.credits(spark, d).where("role = 'featured'").select("work_id", "person_id").join(T.people(spark, d).select("person_id", "name"), "person_id")
    n = n.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    k = F.col("work_id")
    own = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("given "), "title"))
    return T.works(spark, d).join(n, "work_id", "left").select("work_id", F.coalesce(F.nullif(own, F.lit("")), "names").alias("featured"))


@query(f"""{with_tables("works", "credits", "people")}, c AS (SELECT DISTINCT work_id, person_id FROM credits WHERE role = 'featured'), l AS (SELECT work_id, string_agg(person_id, ',' ORDER BY person_id) AS list FROM c GROUP BY work_id),
g AS (SELECT person_id, list, count(*) AS works, min(title) AS sample FROM c JOIN l USING (work_id) JOIN works USING (work_id) WHERE work_status = 'published' GROUP BY ALL)
SELECT person_id, list, works, sample FROM g QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY works DESC, list) <= 3""")
def credit_lists_of_person(spark: SparkSession, d: str) -> DataFrame:
    """The three credit lists under which a person appears most often, with a sample title."""
    c = T.credits(spark, d).where("role = 'featured'").select("work_id", "person_id").distinct()
    lists = c.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("person_id")), lambda x: x.cast("string")), ",").alias("list"))
    g = c.join(lists, "work_id").join(T.works(spark, d).where("work_status = 'published'").select("work_id", "title"), "work_id")
    g = g.groupBy("person_id", "list").agg(F.count("*").alias("works"), F.min("title").alias("sample"))
    place = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("works"), "list"))
    return g.withColumn("place", place).where("place <= 3").drop("place")


@query(f"""{with_tables("works", "credits", "people", "listings")}, a AS (SELECT work_id, list_distinct(list(lower(alias))) AS names FROM credits JOIN people USING (person_id) WHERE role = 'featured' GROUP BY work_id),
v AS (SELECT source_id, l.work_id, [lower(segment) || '-' || (l.work_id % 97), lower(name)] AS verified FROM listings l JOIN people p ON p.person_id = l.work_id),
c AS (SELECT source_id, CASE WHEN names IS NULL THEN 'no_credit' WHEN list_has_any(names, verified) THEN 'verified_name' ELSE 'other_name' END AS cls FROM v LEFT JOIN a USING (work_id))
SELECT source_id, count(*) FILTER (WHERE cls = 'no_credit') AS no_credit, count(*) FILTER (WHERE cls = 'other_name') AS other_name, count(*) FILTER (WHERE cls = 'verified_name') AS verified_name FROM c GROUP BY source_id""")
def credit_gap_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per source, listings whose work credits nobody, someone else, or one of the verified names of the person they came with."""
    p = T.people(spark, d)
    a = T.credits(spark, d).where("role = 'featured'").join(p.select("person_id", "alias"), "person_id").groupBy("work_id").agg(F.collect_set(F.lower("alias")).alias("names"))
    v = T.listings(spark, d).select("source_id", "work_id").join(p.select(F.col("person_id").alias("work_id"), "segment", "name"), "work_id")
    verified = F.array(F.concat(F.lower("segment"), F.lit("-"), (F.col("work_id") % 97).cast("string")), F.lower("name"))
    cls = F.when(F.col("names").isNull(), "no_credit").when(F.arrays_overlap("names", verified), "verified_name").otherwise("other_name")
    return v.join(a, "work_id", "left").withColumn("cls", cls).groupBy("source_id").pivot("cls", ["no_credit", "other_name", "verified_name"]).count().na.fill(0)


# --- reviewed corrections ----------------------------------------------------------------------------------------


@query(f"""{with_tables("observations", "sources")}, s AS (SELECT thread, arg_min(observed_at, (line, work_id, price_minor, quantity)) AS row_at FROM observations GROUP BY thread),
e AS (SELECT thread, max(observed_at) AS sold_at, arg_max(price_minor, (observed_at, price_minor)) AS sold_minor FROM observations JOIN sources USING (source_id) WHERE status = 'completed' AND source_format = 'physical' GROUP BY thread)
SELECT thread, CASE WHEN sold_at >= row_at THEN sold_at END AS sold_at, CASE WHEN sold_at >= row_at THEN sold_minor END AS sold_minor FROM s LEFT JOIN e USING (thread)""")
def sale_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The latest physical sale of a thread becomes its evidence unless the stored row is newer than that."""
    o = T.observations(spark, d)
    row = o.groupBy("thread").agg(F.min(F.struct("line", "work_id", "price_minor", "quantity", "observed_at")).alias("f")).select("thread", F.col("f.observed_at").alias("row_at"))
    physical = T.sources(spark, d).where("source_format = 'physical'").select("source_id")
    e = o.where("status = 'completed'").join(physical, "source_id").groupBy("thread").agg(F.max(F.struct("observed_at", "price_minor")).alias("e"))
    fresh = F.col("e.observed_at") >= F.col("row_at")
    return row.join(e, "thread", "left").select("thread", F.when(fresh, F.col("e.observed_at")).alias("sold_at"), F.when(fresh, F.col("e.price_minor")).alias("sold_minor"))


_MEDIA_TYPES = "CASE page_id % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'sample' ELSE 'back' END"


@query(f"""WITH m AS (SELECT page_id AS media_id, CASE WHEN page_id % 2 = 0 THEN 'work' ELSE 'edition' END AS entity, page_id // 8 AS id, {_MEDIA_TYPES} AS media_type FROM pages),
x AS (SELECT media_id, entity = 'work' AS moves, id, media_type, count(*) FILTER (WHERE entity = 'edition') OVER (PARTITION BY id, media_type) AS there, row_number() OVER (PARTITION BY entity, id, media_type ORDER BY media_id) AS nth FROM m)
SELECT media_id, id AS edition, CASE WHEN moves AND (there > 0 OR nth > 1) THEN 'work_' || media_id ELSE media_type END AS media_type FROM x""")
def media_move(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of a work move to its edition; where the edition has that type already, or an earlier picture took it, they get a name of their own."""
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "cover").when(k % 3 == 1, "sample").otherwise("back")
    m = T.table(spark, d, "pages").select(k.alias("media_id"), F.when(k % 2 == 0, "work").otherwise("edition").alias("entity"), F.floor(k / 8).alias("id"), kind.alias("media_type"))
    there = m.where("entity = 'edition'").select("id", "media_type", F.lit(True).alias("there")).distinct()
    nth = F.row_number().over(Window.partitionBy("entity", "id", "media_type").orderBy("media_id"))
    m = m.withColumn("nth", nth).join(there, ["id", "media_type"], "left")
    renamed = (F.col("entity") == "work") & (F.coalesce("there", F.lit(False)) | (F.col("nth") > 1))
    return m.select("media_id", F.col("id").alias("edition"), F.when(renamed, F.concat(F.lit("work_"), F.col("media_id").cast("string"))).otherwise(F.col("media_type")).alias("media_type"))


@query(f"""{with_tables("listings", "editions", "works")}, r AS (SELECT listing_id, title, edition_id AS l_edition, l.work_id * 2 + CASE WHEN quantity % 9 = 0 THEN 1 - CAST(format = 'digital' AS INT) ELSE CAST(format = 'digital' AS INT) END AS wanted,
  {_sql_pick("quantity", "reviewed_isbn", "reviewed_title_cover", "guess")} AS method, CASE WHEN quantity % 10 = 0 THEN '' ELSE 'seen' END AS evidence, CASE WHEN quantity % 11 = 0 THEN 'x' ELSE title END AS expected, format FROM listings l JOIN works w USING (work_id))
SELECT CASE WHEN method = 'guess' OR evidence = '' OR expected = '' THEN 'incomplete' WHEN e.edition_id IS NULL THEN 'edition' WHEN expected <> title THEN 'title' WHEN l_edition IS NOT NULL AND l_edition <> wanted THEN 'other_edition' WHEN r.format <> e.format THEN 'format' ELSE 'applies' END AS verdict, count(*) AS n
FROM r LEFT JOIN editions e ON e.edition_id = wanted AND e.edition_status = 'published' GROUP BY 1""")
def reviewed_match_guards(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed matches apply only to what was reviewed: complete, a published edition, the same title, no other link, one format."""
    q = F.col("quantity")
    digital = (F.col("format") == "digital").cast("int")
    r = T.listings(spark, d).join(T.works(spark, d).select("work_id", "title"), "work_id").select(
        "title", F.col("edition_id").alias("l_edition"), F.col("format").alias("l_format"), (F.col("work_id") * 2 + F.when(q % 9 == 0, 1 - digital).otherwise(digital)).alias("wanted"),
        _pick(q, "reviewed_isbn", "reviewed_title_cover", "guess").alias("method"), F.when(q % 10 == 0, "").otherwise("seen").alias("evidence"), F.when(q % 11 == 0, "x").otherwise(F.col("title")).alias("expected"),
    )
    e = T.editions(spark, d).where("edition_status = 'published'").select(F.col("edition_id").alias("wanted"), "format")
    verdict = (
        F.when((F.col("method") == "guess") | (F.col("evidence") == "") | (F.col("expected") == ""), "incomplete").when(F.col("format").isNull(), "edition").when(F.col("expected") != F.col("title"), "title")
        .when(F.col("l_edition") != F.col("wanted"), "other_edition").when(F.col("l_format") != F.col("format"), "format").otherwise("applies")
    )
    return r.join(e, "wanted", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT page_id // 2 AS edition, url AS cover FROM pages), r AS (SELECT page_id // 2 AS edition, CASE WHEN page_id % 5 = 0 THEN 'https://old.example/' ELSE url END AS old, 'https://new.example/' || page_id AS new FROM pages WHERE page_id % 2 = 0),
n AS (SELECT r.edition, old, new, count(*) FILTER (WHERE cover IN (old, new)) AS hits FROM r LEFT JOIN c USING (edition) GROUP BY ALL)
SELECT edition, hits = 1 AS applies, CASE WHEN hits = 1 THEN new END AS cover FROM n""")
def cover_repairs(spark: SparkSession, d: str) -> DataFrame:
    """A repair applies if exactly one row still has the cover that was reviewed, or the new one already."""
    p = T.table(spark, d, "pages").select("page_id", "url", F.floor(F.col("page_id") / 2).alias("edition"))
    r = p.where("page_id % 2 = 0").select("edition", F.when(F.col("page_id") % 5 == 0, "https://old.example/").otherwise(F.col("url")).alias("old"), F.concat(F.lit("https://new.example/"), F.col("page_id").cast("string")).alias("new"))
    hit = (F.col("url") == F.col("old")) | (F.col("url") == F.col("new"))
    n = r.join(p.select("edition", "url"), "edition", "left").groupBy("edition", "old", "new").agg(F.count_if(hit).alias("hits"))
    one = F.col("hits") == 1
    return n.select("edition", one.alias("applies"), F.when(one, F.col("new")).alias("cover"))


@query(f"""{with_tables("works", "editions")}, r AS (SELECT edition_id, work_id AS source, work_id + 10 AS target FROM editions WHERE edition_id % 3 = 0), n AS (SELECT work_id, count(*) AS editions FROM editions WHERE edition_status = 'published' GROUP BY work_id)
SELECT CASE WHEN t.work_id IS NULL THEN 'no_target' WHEN s.publication_type <> 'magazine_issue' OR t.publication_type <> 'magazine_issue' THEN 'no_issue' WHEN s.issue_month <> t.issue_month OR s.origin_key <> t.origin_key THEN 'other_issue'
  WHEN t.work_status <> 'published' OR s.work_status <> 'published' THEN 'status' WHEN e.format <> 'physical' THEN 'format' WHEN coalesce(editions, 0) > 2 THEN 'not_sole' ELSE 'moves' END AS verdict, count(*) AS n
FROM r JOIN editions e USING (edition_id) JOIN works s ON s.work_id = source LEFT JOIN works t ON t.work_id = target LEFT JOIN n ON n.work_id = source GROUP BY 1""")
def issue_reassignment(spark: SparkSession, d: str) -> DataFrame:
    """An edition moves to another work only within one published magazine issue."""
    side = lambda x: T.works(spark, d).select(*(F.col(c).alias(f"{x}_{c}") for c in ("work_id", "publication_type", "issue_month", "origin_key", "work_status")))
    e = T.editions(spark, d)
    n = e.where("edition_status = 'published'").groupBy(F.col("work_id").alias("source")).agg(F.count("*").alias("editions"))
    r = e.where("edition_id % 3 = 0").select("format", F.col("work_id").alias("source"), (F.col("work_id") + 10).alias("target"))
    df = r.join(side("s"), F.col("source") == F.col("s_work_id")).join(side("t"), F.col("target") == F.col("t_work_id"), "left").join(n, "source", "left")
    verdict = (
        F.when(F.col("t_work_id").isNull(), "no_target").when((F.col("s_publication_type") != "magazine_issue") | (F.col("t_publication_type") != "magazine_issue"), "no_issue")
        .when((F.col("s_issue_month") != F.col("t_issue_month")) | (F.col("s_origin_key") != F.col("t_origin_key")), "other_issue").when((F.col("t_work_status") != "published") | (F.col("s_work_status") != "published"), "status")
        .when(F.col("format") != "physical", "format").when(F.coalesce("editions", F.lit(0)) > 2, "not_sole").otherwise("moves")
    )
    return df.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("editions")}, c AS (SELECT edition_id, work_id, {_sql_pick("edition_id", "", "limited", "")} AS variant, edition_publisher FROM editions WHERE format = 'physical'),
k AS (SELECT *, min(edition_id) OVER (PARTITION BY work_id // 4, variant) AS kept FROM c)
SELECT kept, count(*) AS merged, min(work_id) AS work_id FROM k GROUP BY kept""")
def edition_identity(spark: SparkSession, d: str) -> DataFrame:
    """Physical editions of one work (four neighbours stand in for one) and variant are the first one, and have its work."""
    c = T.editions(spark, d).where("format = 'physical'").groupBy(F.floor(F.col("work_id") / 4), _pick(F.col("edition_id"), "", "limited", ""))
    return c.agg(F.min("edition_id").alias("kept"), F.count("*").alias("merged"), F.min("work_id").alias("work_id")).select("kept", "merged", "work_id")


@query(f"""{with_tables("editions", "works")}, p AS (SELECT work_id, work_id * 2 AS physical, work_id * 2 + 1 AS digital, CASE WHEN work_id % 7 = 0 THEN 'changed' ELSE lower(title) END AS title, publisher, CASE WHEN work_id % 6 = 0 THEN '9780000000000' END AS isbn FROM works WHERE work_id % 2 = 0),
j AS (SELECT p.*, w.title AS now, a.format AS fa, b.format AS fb, a.edition_publisher AS pa, a.isbn AS now_isbn FROM p JOIN works w USING (work_id) LEFT JOIN editions a ON a.edition_id = physical LEFT JOIN editions b ON b.edition_id = digital)
SELECT CASE WHEN fa IS NULL OR fb IS NULL THEN 'missing' WHEN fa <> 'physical' OR fb <> 'digital' THEN 'format' WHEN title <> lower(now) OR publisher <> pa THEN 'evidence_changed' WHEN isbn IS NOT NULL AND isbn <> now_isbn THEN 'isbn_changed' ELSE 'pairs' END AS verdict, count(*) AS n FROM j GROUP BY 1""")
def cross_format_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed pairs of a printed and a digital edition hold only while the evidence they rest on is the same."""
    k = F.col("work_id")
    p = T.works(spark, d).where("work_id % 2 = 0").select(k, F.lower("title").alias("now"), F.when(k % 7 == 0, "changed").otherwise(F.lower("title")).alias("title"), "publisher", F.when(k % 6 == 0, "9780000000000").alias("isbn"))
    e = T.editions(spark, d)
    a = e.where("edition_id % 2 = 0").select((F.col("edition_id") / 2).cast("long").alias("work_id"), F.col("format").alias("fa"), F.col("edition_publisher").alias("pa"), F.col("isbn").alias("now_isbn"))
    b = e.where("edition_id % 2 = 1").select(F.floor(F.col("edition_id") / 2).alias("work_id"), F.col("format").alias("fb"))
    verdict = (
        F.when(F.col("fa").isNull() | F.col("fb").isNull(), "missing").when((F.col("fa") != "physical") | (F.col("fb") != "digital"), "format")
        .when((F.col("title") != F.col("now")) | (F.col("publisher") != F.col("pa")), "evidence_changed").when(F.col("isbn") != F.col("now_isbn"), "isbn_changed").otherwise("pairs")
    )
    return p.join(a, "work_id", "left").join(b, "work_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("works")}, r AS (SELECT CASE WHEN work_id % 4 = 0 THEN NULL ELSE 'https://a.example/' || (work_id // 3) END AS page, title, publisher AS term, work_id FROM works)
SELECT coalesce(page, title) AS record, count(*) AS hits, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, min(work_id) AS first FROM r GROUP BY 1""")
def record_merge(spark: SparkSession, d: str) -> DataFrame:
    """Records found under several search terms are one record, by page or else by content, with all its terms."""
    page = F.when(F.col("work_id") % 4 != 0, F.concat(F.lit("https://a.example/"), F.floor(F.col("work_id") / 3).cast("string")))
    r = T.works(spark, d).groupBy(F.coalesce(page, F.col("title")).alias("record"))
    return r.agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("publisher")), ",").alias("terms"), F.min("work_id").alias("first"))


@query("""WITH t AS (SELECT user_id AS sheet, event_id AS tile, CAST(floor(value) AS INT) AS x, CAST(json_extract(props, '$.k') AS INT) AS y FROM events),
g AS (SELECT *, CASE WHEN y - lag(y) OVER w <= 15 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY sheet ORDER BY y, x, tile)),
r AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY y, x, tile) AS visual_row FROM g)
SELECT sheet, tile, CAST(visual_row AS BIGINT) AS visual_row, row_number() OVER (PARTITION BY sheet ORDER BY visual_row, x, tile) AS place FROM r""")
def tile_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a sheet in reading order: heights less than a tolerance apart are one row, rows go from left to right. A user's
    events are tiles: their values are how far right they stand, their properties how far down."""
    t = T.table(spark, d, "events").select(F.col("user_id").alias("sheet"), F.col("event_id").alias("tile"), F.floor("value").cast("int").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"))
    down = Window.partitionBy("sheet").orderBy("y", "x", "tile")
    t = t.withColumn("new", F.when(F.col("y") - F.lag("y").over(down) <= 15, 0).otherwise(1)).withColumn("visual_row", F.sum("new").over(down).cast("long"))
    return t.select("sheet", "tile", "visual_row", F.row_number().over(Window.partitionBy("sheet").orderBy("visual_row", "x", "tile")).alias("place"))


# --- titles, names and addresses ---------------------------------------------------------------------------------

_SUFFIXES = (
    "", "DVD", "DVD付き 写真集", "カレンダー", "photo book calendar", "イラスト", "増刊", "テレホンカード 50度数", "生成AI", "ダウンロード販売", "ヤングジャンプ 12号", "ヤングジャンプ", "雑誌", "EX大衆 デジタル写真集", "漫画アクションデジタル写真集付き",
    "週刊現代 デジタル写真集 イラスト", "写真集 with postcard", "写真集 トレカ", "photo book calendar card", "artbook", "生写真", "寫真 model kit", "2024年5月号", "フォトCD 写真集", "Jr. 水着",
)


def _sql_words(words: tuple[str, ...]) -> str:
    """The same words for another regular expression engine, written out on their own."""
    return "(?i)(" + "|".join(r"\b" + w.replace(" ", r"\s*") + r"\b" if w.isascii() else w for w in words) + ")"


def _sql_titles(t: str) -> str:
    cases = "".join(f" WHEN regexp_matches({t}, '{p}'){f" AND NOT regexp_matches({t}, '{rules.STRONG_SIGNAL}')" if out else ''} THEN '{c}'" for c, p, out in rules.TITLE_RULES)
    return f"CASE{cases} END"


_TITLES_SQL = f"""{with_tables("works")}, t AS (SELECT title || ' ' || {_sql_pick("work_id", *_SUFFIXES)} AS t FROM works)"""


@query(f"""{_TITLES_SQL}, c AS (SELECT t, {_sql_titles("t")} AS code FROM t),
e AS (SELECT *, code IN ('magazine_only', 'magazine_or_supplement') AND (contains(t, 'デジタル写真集') OR (contains(t, 'グラビアン魂') AND contains(t, '写真集'))) AND NOT regexp_matches(t, '{rules.WITH_MAGAZINE}') AS own, regexp_replace(t, '{rules.MAGAZINE_BRANDS}', '', 'g') AS bare FROM c)
SELECT coalesce(code, 'kept') AS code, coalesce(CASE WHEN own THEN {_sql_titles("bare")} ELSE code END, 'kept') AS digital_code, count(*) AS n FROM e GROUP BY ALL""")
def title_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Titles by the first rule that fits, and as digital books."""
    t = F.concat("title", F.lit(" "), _pick(F.col("work_id"), *_SUFFIXES))
    code, digital = (F.coalesce(f(t), F.lit("kept")) for f in (rules.title_exclusion, rules.digital_title_exclusion))
    return T.works(spark, d).groupBy(code.alias("code"), digital.alias("digital_code")).agg(F.count("*").alias("n"))


@query(f"""{_TITLES_SQL}, b AS (SELECT t, regexp_replace(t, '{rules.BONUS}', ' ', 'g') AS b, replace(t, '生写真', '') AS w FROM t),
s AS (SELECT t, regexp_matches(w, '{rules.WEAK_SIGNAL.replace("(?<!生)", "")}') OR regexp_matches(t, '{rules.STRONG_SIGNAL}') AS said, regexp_matches(b, '{rules.STRONG_SIGNAL}') AS strong,
  regexp_matches(b, '{rules.NOT_BOOKS}') AS thing, regexp_matches(b, '{rules.SCALE_MODELS}') AS scale, regexp_matches(b, '{rules.CARDS}') OR regexp_matches(b, '{rules.ALBUMS}') AS card, regexp_matches(b, '{rules.ARTBOOKS}') AND NOT regexp_matches(b, '{rules.PHOTOGRAPHY}') AS art FROM b)
SELECT said AND NOT (thing OR scale OR (card AND NOT strong) OR art) AS photobook, count(*) AS n FROM s GROUP BY 1""")
def photobook_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that say they are photobooks, extras aside."""
    t = F.concat("title", F.lit(" "), _pick(F.col("work_id"), *_SUFFIXES))
    return T.works(spark, d).groupBy(rules.looks_like_photobook(t).alias("photobook")).agg(F.count("*").alias("n"))


_OFFER_TEXTS = ("ebook edition", "paperback", "printed book with ebook bonus", "PDF", "used copy", "hardcover, QR code to digital extras", "電子書")


@query(f"""{with_tables("works")}, t AS (SELECT title || ' ' || {_sql_pick("work_id", *_OFFER_TEXTS)} AS t, {_sql_pick("work_id // 7", "digital_store", "bookstore", "auction")} AS kind FROM works),
f AS (SELECT *, regexp_matches(t, '{_sql_words(rules.DIGITAL)}') AS e, regexp_matches(t, '{_sql_words(rules.PRINTED)}') AS p, regexp_matches(t, '{_sql_words(rules.EXTRAS)}') AS x FROM t)
SELECT kind, CASE WHEN e THEN CASE WHEN p AND x THEN 'physical' ELSE 'digital' END WHEN kind = 'digital_store' AND NOT p THEN 'digital' ELSE 'physical' END AS format, count(*) AS n FROM f GROUP BY ALL""")
def inferred_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats from offer texts; these are short, so all their words are near each other (tests have long ones)."""
    k = F.col("work_id")
    kind = _pick(F.floor(k / 7), "digital_store", "bookstore", "auction")
    t = F.concat("title", F.lit(" "), _pick(k, *_OFFER_TEXTS))
    return T.works(spark, d).groupBy(kind.alias("kind"), rules.inferred_format(t, kind).alias("format")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("works", "people")}, t AS (SELECT work_id, CASE work_id % 3 WHEN 0 THEN name || ' 写真集 new' WHEN 1 THEN 'new photobook ' || name ELSE title || ' photo book' END AS t, name FROM works JOIN people ON person_id = work_id)
SELECT work_id, contains(regexp_replace(lower(regexp_extract(t, '^(.*?)({_sql_words(rules.SIGNALS)}|$)', 1)), '[^\\pL\\pN]+', '', 'g'), regexp_replace(lower(name), '[^\\pL\\pN]+', '', 'g')) AS names_it FROM t""")
def subject_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a title names its person before the word for a photobook."""
    k = F.col("work_id")
    df = T.works(spark, d).join(T.people(spark, d).select(F.col("person_id").alias("work_id"), "name"), "work_id")
    t = F.when(k % 3 == 0, F.concat("name", F.lit(" 写真集 new"))).when(k % 3 == 1, F.concat(F.lit("new photobook "), "name")).otherwise(F.concat("title", F.lit(" photo book")))
    return df.select("work_id", rules.subject_matches(t, F.array("name")).alias("names_it"))


@query(f"""{with_tables("people")}, p AS (SELECT person_id, name, alias, substr(name, 5, 8) AS part, name || ' ' || segment AS long FROM people),
a AS (SELECT person_id, name, unnest([alias, part, long, name]) AS a, unnest([1, 2, 3, 4]) AS i FROM p),
k AS (SELECT *, regexp_replace(lower(a), '[^\\pL\\pN]+', '', 'g') AS ka, regexp_replace(lower(name), '[^\\pL\\pN]+', '', 'g') AS kn FROM a),
g AS (SELECT * FROM k WHERE ka <> kn AND NOT (contains(kn, ka) AND length(ka) < length(kn)) AND (len(regexp_extract_all(a, '[A-Za-z0-9]+')) >= 2 OR length(ka) >= 3)),
o AS (SELECT person_id, arg_min(a, i) AS a, min(i) AS i FROM g GROUP BY person_id, ka)
SELECT p.person_id, p.name || coalesce('|' || string_agg(o.a, '|' ORDER BY o.i), '') AS names FROM p LEFT JOIN o USING (person_id) GROUP BY p.person_id, p.name""")
def search_names(spark: SparkSession, d: str) -> DataFrame:
    """Names to search each person by: fragments of the full name are left out."""
    aliases = F.array(F.col("alias"), F.substring("name", 5, 8), F.concat("name", F.lit(" "), "segment"), F.col("name"))
    return T.people(spark, d).select("person_id", F.array_join(rules.search_names(F.array("name"), aliases), "|").alias("names"))


@query(f"""{with_tables("works")}, t AS (SELECT work_id, title || ' (' || publisher || ') [e-book]' AS title, CASE work_id % 4 WHEN 0 THEN title WHEN 1 THEN title || ' ' || publisher || ' full colour edition' WHEN 2 THEN substr(title, 1, 4) ELSE upper(title) || '【x】' END AS label FROM works),
k AS (SELECT work_id, regexp_replace(lower(regexp_replace(label, '【x】$', '')), '[^\\pL\\pN]+', '', 'g') AS a, regexp_replace(lower(regexp_replace(title, ' \\(.*$', '')), '[^\\pL\\pN]+', '', 'g') AS b FROM t),
s AS (SELECT work_id, a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM k)
SELECT work_id, CASE WHEN length(b) < 6 THEN a = b ELSE starts_with(long, short) AND length(short) * 100 >= length(long) * 55 END AS fits FROM s""")
def cover_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether a picture's label is the selected title's."""
    k = F.col("work_id")
    label = F.when(k % 4 == 0, F.col("title")).when(k % 4 == 1, F.concat("title", F.lit(" "), "publisher", F.lit(" full colour edition"))).when(k % 4 == 2, F.substring("title", 1, 4)).otherwise(F.concat(F.upper("title"), F.lit("【x】")))
    title = F.concat("title", F.lit(" ("), "publisher", F.lit(") [e-book]"))
    return T.works(spark, d).select("work_id", rules.label_fits(label, title).alias("fits"))


@query(rf"""WITH c AS (SELECT page_id, [url || '/p_Mask.png', regexp_replace(url, '[0-9]+$', 'NoImage.jpg'), replace(url, 'https:', 'http:') || '/cover.jpg', url || '.jpg?w=1'] AS c FROM pages)
SELECT page_id, list_filter(c, lambda u: regexp_matches(u, '^https://[^/\s]+/') AND lower(regexp_extract(u, '([^/?#]*)([?#].*)?$', 1)) NOT IN {rules.PLACEHOLDERS} AND NOT regexp_matches(lower(regexp_extract(u, '([^/?#]*)([?#].*)?$', 1)), '_mask[.][a-z]+$'))[1] AS cover FROM c""")
def cover_urls(spark: SparkSession, d: str) -> DataFrame:
    """The first picture that is a cover, of those that stand at pages' addresses: a masked one, a placeholder, an insecure one, one more."""
    u = F.col("url")
    c = F.array(F.concat(u, F.lit("/p_Mask.png")), F.regexp_replace(u, "[0-9]+$", "NoImage.jpg"), F.concat(F.replace(u, F.lit("https:"), F.lit("http:")), F.lit("/cover.jpg")), F.concat(u, F.lit(".jpg?w=1")))
    return T.table(spark, d, "pages").select("page_id", rules.cover_url(c).alias("cover"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://books.example.com/tw/book/some-title/id' || page_id || '?ref=x' WHEN 1 THEN 'https://m.example.org/single?pid=' || page_id || '&l=2' WHEN 2 THEN 'https://auctions.example.net/auction/q' || page_id
  WHEN 3 THEN 'https://item.example.net/search?q=' || page_id ELSE url END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'numbered_book' WHEN 1 THEN 'product_page' WHEN 2 THEN 'auction' WHEN 3 THEN NULL ELSE CASE WHEN regexp_matches(url, '^https?://([^/?#:]+[.])?example[.](com|net|org)/[a-z]{2}/[0-9]+([/.?#]|$)') THEN 'language_page' END END AS store,
  CASE page_id % 5 WHEN 0 THEN 'https://books.example.com/book/id' || page_id WHEN 1 THEN 'https://www.example.org/product/' || page_id WHEN 2 THEN 'https://auctions.example.net/auction/q' || page_id WHEN 3 THEN NULL
  ELSE CASE WHEN regexp_matches(url, '^https?://([^/?#:]+[.])?example[.](com|net|org)/[a-z]{2}/[0-9]+([/.?#]|$)') THEN 'https://' || lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END END AS address FROM u""")
def store_items(spark: SparkSession, d: str) -> DataFrame:
    """Store, and address of the item alone, of result pages."""
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("https://books.example.com/tw/book/some-title/id"), s, F.lit("?ref=x"))).when(k % 5 == 1, F.concat(F.lit("https://m.example.org/single?pid="), s, F.lit("&l=2")))
        .when(k % 5 == 2, F.concat(F.lit("https://auctions.example.net/auction/q"), s)).when(k % 5 == 3, F.concat(F.lit("https://item.example.net/search?q="), s)).otherwise(F.col("url"))
    )
    x = rules.store_item(url)
    return T.table(spark, d, "pages").select("page_id", x["store"].alias("store"), x["address"].alias("address"))


@query("""WITH t AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 IN (2, 3) THEN date_trunc('day', ts) ELSE ts END AS at FROM t""")
def parsed_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments in the ways in which sources write them."""
    ts, k = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id")
    form = lambda f: F.date_format(ts, f)
    seconds = F.unix_timestamp(ts)
    text = (
        F.when(k % 6 == 0, F.when(seconds.between(10**9, 10**10 - 1), seconds.cast("string")).otherwise(form("yyyy-MM-dd HH:mm:ss"))).when(k % 6 == 1, form("yyyy/M/d H:mm:ss")).when(k % 6 == 2, form("yyyy年M月d日"))
        .when(k % 6 == 3, form("yyyy.MM.dd")).when(k % 6 == 4, form("yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    )
    return T.table(spark, d, "events").select("event_id", F.to_timestamp_ntz(rules.moment(text).cast("string")).alias("at"))


@query(f"""{with_tables("observations", "sources")} SELECT kind, CASE WHEN kind = 'auction' THEN 'auction_hammer' WHEN kind = 'marketplace' AND quantity % 2 = 0 THEN 'auction_hammer' ELSE 'fixed_price_sold' END AS price_type,
  count(*) AS n, CAST(sum(CASE WHEN quantity % 3 <> 2 THEN price_minor END) AS BIGINT) AS sold, CAST(sum(CASE WHEN quantity % 3 = 1 THEN line END) AS BIGINT) AS current FROM observations JOIN sources USING (source_id) GROUP BY ALL""")
def sale_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by the words before them, and what kind of price they are."""
    q, p, n = F.col("quantity"), F.col("price_minor").cast("string"), F.col("line").cast("string")
    text = F.concat(
        F.when(q % 3 == 0, F.concat(F.lit("落札価格 "), p, F.lit("円"))).when(q % 3 == 1, F.concat(F.lit("現在 "), n, F.lit("円 sold for: "), p)).otherwise(F.concat(F.lit("最低落札価格 "), p, F.lit("円"))), F.when(q % 2 == 0, " 3 bids").otherwise(" no offers of bidding"),
    )
    o = T.observations(spark, d).join(T.sources(spark, d).select("source_id", "kind"), "source_id")
    kind = rules.sale_price_type(F.col("kind"), text, F.lit("x"))
    return o.groupBy("kind", kind.alias("price_type")).agg(F.count("*").alias("n"), F.sum(rules.labelled_amount(text, rules.SOLD_LABELS)).alias("sold"), F.sum(rules.labelled_amount(text, rules.OPEN_LABELS)).alias("current"))


# --- pages, cursors and reports ----------------------------------------------------------------------------------


_NODES = r"""WITH t AS (SELECT page_id, html, length(html) AS n, regexp_extract(html, '<title>([^<"\\\\]*)', 1) AS title FROM pages),
h AS (SELECT page_id, html || CASE n % 4 WHEN 0 THEN s || '{"@type": "Book", "name": "' || title || '", "offers": {"price": "' || n || '", "priceCurrency": "JPY"}}' || e || s || '{"@type": "BreadcrumbList", "name": "Home"}' || e
  WHEN 1 THEN s || '{"@type": "Product", "name": "' || title || '"}' || e || s || '[{"@type": "Product", "name": "' || title || '"}, {"@type": "BreadcrumbList"}]' || e
  WHEN 2 THEN s || '{"@type": "Book", "name": "' || title || '"}' || e || s || '{"@type": "Book", "name": "' || n || '"}' || e ELSE s || '{"@type": "Book", "name": "' || title || e END AS html
  FROM t, (VALUES ('<script type="application/ld+json">', '</script>')) AS w(s, e))"""


@query(_NODES + r""", x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)) AS s FROM h),
j AS (SELECT page_id, CAST(s AS JSON) AS j FROM x WHERE json_valid(s)), o AS (SELECT page_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS o FROM j),
f AS (SELECT DISTINCT page_id, json_extract_string(o, '$."@type"') AS type, json_extract_string(o, '$.name') AS name, json_extract_string(o, '$.isbn') AS isbn, json_extract_string(o, '$.offers.price') AS price, json_extract_string(o, '$.offers.priceCurrency') AS currency FROM o),
g AS (SELECT page_id, count(*) AS k, any_value(name) AS name, any_value(price) AS price, any_value(currency) AS currency FROM f WHERE type IN ('Book', 'Product') GROUP BY page_id)
SELECT page_id, CASE WHEN k = 1 THEN name END AS name, CASE WHEN k = 1 THEN price END AS price, CASE WHEN k = 1 THEN currency END AS currency FROM pages LEFT JOIN g USING (page_id)""")
def product_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Structured data at the end of pages, with their own titles: one node, the same node twice, two different ones, and broken JSON."""
    title, n = F.regexp_extract("html", r'<title>([^<"\\]*)', 1), F.length("html")
    script = lambda *body: F.concat(F.lit('<script type="application/ld+json">'), *(F.lit(x) if isinstance(x, str) else x for x in body), F.lit("</script>"))
    more = (
        F.when(n % 4 == 0, F.concat(script('{"@type": "Book", "name": "', title, '", "offers": {"price": "', n.cast("string"), '", "priceCurrency": "JPY"}}'), script('{"@type": "BreadcrumbList", "name": "Home"}')))
        .when(n % 4 == 1, F.concat(script('{"@type": "Product", "name": "', title, '"}'), script('[{"@type": "Product", "name": "', title, '"}, {"@type": "BreadcrumbList"}]')))
        .when(n % 4 == 2, F.concat(script('{"@type": "Book", "name": "', title, '"}'), script('{"@type": "Book", "name": "', n.cast("string"), '"}'))).otherwise(script('{"@type": "Book", "name": "', title))
    )
    node = rules.product_node(F.concat("html", more))
    return T.table(spark, d, "pages").select("page_id", node["name"].alias("name"), node["price"].alias("price"), node["currency"].alias("currency"))


@query(r"""WITH e AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS k, props, event_type, value FROM events),
p AS (SELECT event_id, CASE event_type WHEN 'view' THEN replace(props, '"k": ' || k, '"nextPageToken": "' || k || '"') WHEN 'purchase' THEN '{"meta": {"nextPageToken": "' || k || '"}, "hasMore": ' || (value > 20) || '}' WHEN 'click' THEN '{"pagination": {"next": "' || CASE WHEN length(k) > 1 THEN k ELSE '' END || '"}}'
  WHEN 'error' THEN '{"cursor": "' || k || '", "hasMore": false}' ELSE props END AS p FROM e),
t AS (SELECT event_id, p, coalesce(nullif(json_extract_string(p, '$.nextPageToken'), ''), nullif(json_extract_string(p, '$.meta.nextPageToken'), ''), nullif(json_extract_string(p, '$.pagination.next'), ''), nullif(json_extract_string(p, '$.cursor'), '')) AS token FROM p)
SELECT event_id, token, token IS NOT NULL AND NOT coalesce(json_extract_string(p, '$.hasMore') = 'false', false) AS more FROM t""")
def page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of next pages in answers of different shapes: the events' properties under the names that sources use."""
    e, kind = T.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0)), F.col("event_type")
    s = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    k = F.col("k")
    payload = (
        F.when(kind == "view", F.replace("props", s('"k": ', k), s('"nextPageToken": "', k, '"'))).when(kind == "purchase", s('{"meta": {"nextPageToken": "', k, '"}, "hasMore": ', (F.col("value") > 20).cast("string"), "}"))
        .when(kind == "click", s('{"pagination": {"next": "', F.when(F.length(k) > 1, k).otherwise(""), '"}}')).when(kind == "error", s('{"cursor": "', k, '", "hasMore": false}')).otherwise(F.col("props"))
    )
    c = rules.page_cursor(payload)
    return e.select("event_id", c["token"].alias("token"), c["more"].alias("more"))


@query(f"""{with_tables("works")}, p AS (SELECT work_id, title FROM works WHERE work_status = 'published'), c AS (SELECT title AS t, work_id AS w FROM p ORDER BY title DESC, work_id LIMIT 1 OFFSET 49)
SELECT work_id, title FROM p, c WHERE title < t OR (title = t AND work_id > w) ORDER BY title DESC, work_id LIMIT 24""")
def books_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The page after an encoded cursor; a cursor of another order would give nothing."""
    p = T.works(spark, d).where("work_status = 'published'").select("work_id", "title")
    end = p.orderBy(F.desc("title"), "work_id").offset(49).limit(1).select(rules.encoded_cursor("title_desc", F.col("title"), F.col("work_id")).alias("cursor"))
    at = end.select(rules.decoded_cursor(F.col("cursor"), "title_desc").alias("c")).select(F.col("c.v").alias("t"), F.col("c.k").cast("long").alias("w"))
    # One row.
    rest = p.join(F.broadcast(at), (F.col("title") < F.col("t")) | ((F.col("title") == F.col("t")) & (F.col("work_id") > F.col("w"))))
    return rest.select("work_id", "title").orderBy(F.desc("title"), "work_id").limit(24)


@query(f"""{with_tables("works", "editions")}, d AS (SELECT e.work_id, min(publication_date) AS oldest FROM editions e WHERE edition_status = 'published' GROUP BY e.work_id)
SELECT w.work_id, title, oldest FROM works w LEFT JOIN d USING (work_id) WHERE work_status = 'published' ORDER BY oldest NULLS LAST, work_id LIMIT 24""")
def books_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    """The oldest sort: undated works come last here as well."""
    old = T.editions(spark, d).where("edition_status = 'published'").groupBy("work_id").agg(F.min("publication_date").alias("oldest"))
    df = T.works(spark, d).where("work_status = 'published'").join(old, "work_id", "left")
    return df.select("work_id", "title", "oldest").orderBy(F.asc_nulls_last("oldest"), "work_id").limit(24)


@query(f"""{with_tables("observations")}, b AS (SELECT source_id, CAST(observed_at AS DATE) AS day, count(*) AS items FROM observations GROUP BY ALL)
SELECT source_id, count(*) AS batches, CAST(sum(CAST(ceil(items / 5.0) AS BIGINT)) AS BIGINT) AS parts, max(least(items, 5)) AS largest FROM b GROUP BY source_id""")
def batch_limits(spark: SparkSession, d: str) -> DataFrame:
    """Batches cut to the size that intake allows (five here). How many parts a batch makes follows from its size, so no batch is
    sorted or held by a task."""
    b = T.observations(spark, d).groupBy("source_id", F.col("observed_at").cast("date").alias("day")).agg(F.count("*").alias("items"))
    return b.groupBy("source_id").agg(F.count("*").alias("batches"), F.sum(F.ceil(F.col("items") / 5)).cast("long").alias("parts"), F.max(F.least("items", F.lit(5).cast("long"))).alias("largest"))


@query(f"""{with_tables("listings", "editions", "works", "credits")}, l AS (SELECT * FROM listings WHERE currency = 'JPY'), c AS (SELECT DISTINCT work_id FROM credits),
k AS (SELECT 'listings' AS counter, count(*) AS n FROM l UNION ALL SELECT 'unlinked', count(*) FROM l WHERE edition_id IS NULL UNION ALL SELECT 'unpriced', count(*) FROM l WHERE price_minor <= 0
  UNION ALL SELECT 'format_differs', count(*) FROM l JOIN editions e USING (edition_id) WHERE e.format <> l.format UNION ALL SELECT 'superseded_edition', count(*) FROM l JOIN editions e USING (edition_id) WHERE edition_status <> 'published'
  UNION ALL SELECT 'superseded_work', count(*) FROM l JOIN works w ON w.work_id = l.work_id WHERE work_status <> 'published' UNION ALL SELECT 'without_credit', count(*) FROM l ANTI JOIN c USING (work_id)
  UNION ALL SELECT 'unauthorized_store', count(*) FROM l WHERE kind IN ('bookstore', 'digital_store') AND NOT authorized UNION ALL SELECT 'disabled_source', count(*) FROM l WHERE NOT enabled)
SELECT * FROM k""")
def ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """Integrity, coverage and permission counters of one market's ledger, from one pass over its listings."""
    e = T.editions(spark, d).select("edition_id", F.col("format").alias("e_format"), "edition_status")
    w = T.works(spark, d).select("work_id", "work_status")
    c = T.credits(spark, d).select("work_id").distinct().withColumn("credited", F.lit(True))
    l = T.listings(spark, d).where("currency = 'JPY'").join(e, "edition_id", "left").join(w, "work_id", "left").join(c, "work_id", "left")
    counters = {
        "listings": F.lit(True), "unlinked": F.col("edition_id").isNull(), "unpriced": F.col("price_minor") <= 0, "format_differs": F.col("e_format") != F.col("format"),
        "superseded_edition": F.col("edition_status") != "published", "superseded_work": F.col("work_status") != "published", "without_credit": F.col("credited").isNull(),
        "unauthorized_store": F.col("kind").isin("bookstore", "digital_store") & ~F.col("authorized"), "disabled_source": ~F.col("enabled"),
    }
    n = l.agg(*(F.count_if(v).alias(k) for k, v in counters.items()))
    return n.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counters)), F.array(*map(F.col, counters)))).alias("counter", "n"))


@query(f"""{with_tables("editions", "works", "credits", "listings")}, c AS (SELECT DISTINCT person_id, work_id FROM credits), p AS (SELECT edition_id, min(price_minor) FILTER (WHERE status = 'active') AS low, count(*) AS offers FROM listings WHERE edition_id IS NOT NULL GROUP BY edition_id),
f AS (SELECT person_id, e.*, title, publisher, low, offers FROM c JOIN editions e USING (work_id) JOIN works w USING (work_id) LEFT JOIN p USING (edition_id) WHERE edition_status = 'published')
SELECT person_id, count(*) AS editions, count(*) FILTER (WHERE format = 'physical') AS physical, count(*) FILTER (WHERE format = 'digital') AS digital, count(DISTINCT publisher) AS publishers, count(*) FILTER (WHERE isbn <> '') AS with_isbn,
  count(*) FILTER (WHERE publication_date IS NOT NULL) AS dated, count(*) FILTER (WHERE format = 'digital' AND store_date IS NOT NULL) AS store_dated, count(*) FILTER (WHERE offers > 0) AS offered, count(*) FILTER (WHERE low > 0) AS priced,
  count(*) FILTER (WHERE offers IS NULL AND format = 'physical') AS physical_gap, count(*) FILTER (WHERE offers IS NULL AND format = 'digital') AS digital_gap, min(low) AS low, max(low) AS high, CAST(sum(offers) AS BIGINT) AS offers,
  min(publication_date) AS first_day, max(publication_date) AS last_day FROM f GROUP BY person_id""")
def model_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What the catalog knows of each credited person's published editions, and where it has gaps."""
    l = T.listings(spark, d).where("edition_id IS NOT NULL").groupBy("edition_id").agg(F.min(F.when(F.col("status") == "active", F.col("price_minor"))).alias("low"), F.count("*").alias("offers"))
    e = T.editions(spark, d).where("edition_status = 'published'").join(T.works(spark, d).select("work_id", "publisher"), "work_id").join(l, "edition_id", "left")
    f = T.credits(spark, d).select("person_id", "work_id").distinct().join(e, "work_id")
    paper, file, gap = F.col("format") == "physical", F.col("format") == "digital", F.col("offers").isNull()
    return f.groupBy("person_id").agg(
        F.count("*").alias("editions"), F.count_if(paper).alias("physical"), F.count_if(file).alias("digital"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("isbn") != "").alias("with_isbn"),
        F.count("publication_date").alias("dated"), F.count_if(file & F.col("store_date").isNotNull()).alias("store_dated"), F.count_if(F.col("offers") > 0).alias("offered"), F.count_if(F.col("low") > 0).alias("priced"),
        F.count_if(gap & paper).alias("physical_gap"), F.count_if(gap & file).alias("digital_gap"), F.min("low").alias("low"), F.max("low").alias("high"), F.sum("offers").alias("offers"),
        F.min("publication_date").alias("first_day"), F.max("publication_date").alias("last_day"),
    )


# --- searches, titles and keys -----------------------------------------------------------------------------------


@query(f"""{with_tables("works")}, t AS (SELECT work_id, lower(title) || CASE WHEN work_id % 2 = 0 THEN ' vol.' || (work_id % 7) ELSE ' 第' || (work_id % 5) || '巻' END AS t, CASE WHEN work_id % 2 = 0 THEN work_id % 7 ELSE work_id % 5 END AS v FROM works)
SELECT work_id, CASE work_id % 4 WHEN 0 THEN contains(t, 'small ring') WHEN 1 THEN contains(t, 'ring') AND contains(t, 'small') WHEN 2 THEN contains(t, 'ring') AND v = 4 ELSE contains(t, 'bolt') AND v = 3 END AS answers FROM t""")
def title_answers(spark: SparkSession, d: str) -> DataFrame:
    """Titles against searches with quoted phrases, loose words and volume numbers."""
    k = F.col("work_id")
    number = F.when(k % 2 == 0, F.concat(F.lit(" vol."), (k % 7).cast("string"))).otherwise(F.concat(F.lit(" 第"), (k % 5).cast("string"), F.lit("巻")))
    q = F.when(k % 4 == 0, '"Small ring"').when(k % 4 == 1, "RING, small").when(k % 4 == 2, "ring volume 4").otherwise("3巻 ｂｏｌｔ")
    return T.works(spark, d).select("work_id", rules.title_answers(q, F.concat("title", number)).alias("answers"))


@query(f"""{with_tables("works")} SELECT work_id, title FROM works""")
def cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    """Sellers' words come off."""
    k = F.col("work_id")
    dressed = F.concat(_pick(k, "★送料無料★ ", "● ", "Brand New!! "), "title", _pick(F.floor(k / 3), "  即決", " item #12", " ☆ used"))
    return T.works(spark, d).select("work_id", rules.cleaned_title(dressed).alias("title"))


@query(f"""{with_tables("works")}, b AS (SELECT title, publisher, CASE WHEN work_id % 3 = 0 THEN publisher || ' DVD' WHEN work_id % 3 = 1 THEN publisher || ' $$$$' ELSE publisher || ' ?? ' || title END AS t FROM works)
SELECT CASE WHEN contains(t, '$$$') THEN 'symbols' ELSE 'kept' END AS reason, regexp_matches(t, '[?][?]+') AS corrupt, count(*) AS n FROM b GROUP BY ALL""")
def branded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles judged without their store's brand (which has a # itself), and those whose letters were lost."""
    k = F.col("work_id")
    t = F.concat("publisher", F.when(k % 3 == 0, " DVD").when(k % 3 == 1, " $$$$").otherwise(F.concat(F.lit(" ?? "), "title")))
    return T.works(spark, d).groupBy(F.coalesce(rules.brand_exclusion(t, F.col("publisher")), F.lit("kept")).alias("reason"), texts.corrupt(t).alias("corrupt")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("observations")}, o AS (SELECT source_id, external_id, thread, status, price_minor, currency, CASE WHEN line % 2 = 0 THEN ' ' || thread || '-' || line || ' ' ELSE '' END AS own FROM observations),
k AS (SELECT 'observation-' || substr(sha256(concat_ws(chr(0), source_id, coalesce(nullif(trim(own), ''), concat_ws(chr(0), thread, external_id)))), 1, 40) AS observation, substr(sha256(concat_ws(chr(0), source_id, external_id, status, price_minor, currency)), 1, 40) AS state FROM o)
SELECT substr(observation, 1, 14) AS shard, count(DISTINCT observation) AS observations, count(DISTINCT state) AS states FROM k GROUP BY shard""")
def observation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of observations (the source's own id, or job and item) and of what they show, counted by first digit."""
    s = lambda c: F.col(c).cast("string")
    own = F.when(F.col("line") % 2 == 0, F.concat(F.lit(" "), s("thread"), F.lit("-"), s("line"), F.lit(" "))).otherwise("")
    k = T.observations(spark, d).select(ids.observation_id(s("source_id"), own, s("thread"), F.col("external_id")).alias("observation"), ids.change_key(s("source_id"), F.col("external_id"), F.col("status"), s("price_minor"), F.col("currency")).alias("state"))
    return k.groupBy(F.substring("observation", 1, 14).alias("shard")).agg(F.countDistinct("observation").alias("observations"), F.countDistinct("state").alias("states"))
