"""Grants, evidence and reviewed merges over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.operators import evidence, grants, manifest, merging
from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry, with_tables

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)
_pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
NOW = "1998-06-01"
_FIELDS = ("title,url,format", "title, url ,format,price,currency,availability,observed_at,price_basis", " Title,URL,format,observed_at,availability,price,currency,price_basis,condition")
_SCOPES = ("bibliography", "current_prices", "used_prices", "product_images")


# --- grants ----------------------------------------------------------------------------------------------------------


def order_grants(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for grants: their dates are those of the grants, their numbers vary what is granted."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    days = lambda n: F.make_interval(days=n)
    return T.table(spark, d, "orders").select(
        k.alias("grant_id"), (F.col("o_custkey") % 10 + 1).alias("source_id"), _pick(k, *_SCOPES).alias("scope"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"),
        F.when(k % 11 == 0, "scrape").otherwise("API").alias("access_method"), _pick(k, *_FIELDS).alias("allowed_fields"), F.when(k % 17 == 0, " ").otherwise("indexing").alias("purpose"),
        F.when(k % 7 == 0, "collect").otherwise("collect,Retain,catalog_display").alias("allowed_uses"), F.when(k % 13 == 0, "temporary").otherwise("permanent").alias("retention_mode"),
        (k % 5).cast("int").alias("retention_days"), F.lit("keep").alias("retention_policy"), _pick(k, "attributed", "source_linked", "integrated", "none", "ATTRIBUTED", "framed").alias("display_mode"),
        (k % 2 == 0).alias("attribution_required"), F.when(k % 3 == 0, "").otherwise("source").alias("attribution_text"), (k % 4 == 0).alias("redistribution_allowed"), (k % 19).cast("int").alias("rate_per_minute"),
        F.when(k % 23 == 0, "").otherwise("owner").alias("rightsholder"), F.lit("Global").alias("territory"), F.concat(F.when(k % 29 == 0, "http").otherwise("https"), F.lit("://rights.example/"), k.cast("string")).alias("evidence_url"),
        day.alias("effective_at"), F.when(k % 31 != 0, day + days((k % 40).cast("int"))).alias("reviewed_at"), F.when(k % 6 != 0, day + days(F.lit(1500))).alias("expires_at"),
    )


_pick_sql = lambda k, *v: f"[{', '.join(repr(x) for x in v)}][{k} % {len(v)} + 1]"
_G = f"""g AS (SELECT o_orderkey AS k, o_custkey % 10 + 1 AS source_id, {_pick_sql("o_orderkey", *_SCOPES)} AS scope, o_orderstatus = 'P' AS pending, {_pick_sql("o_orderkey", *_FIELDS)} AS fs,
  lower({_pick_sql("o_orderkey", "attributed", "source_linked", "integrated", "none", "ATTRIBUTED", "framed")}) AS shown, o_orderdate AS since, o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)) AS reviewed, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + INTERVAL 1500 DAY END AS until FROM orders),
h AS (SELECT *, list_transform(string_split(lower(fs), ','), lambda x: trim(x)) AS allowed FROM g)"""


def _denied_sql(uses: str) -> str:
    """The lasting rules, in their order, for a grant of h."""
    return f"""CASE WHEN pending THEN 'status' WHEN k % 11 = 0 THEN 'method' WHEN k % 31 = 0 THEN 'not_reviewed' WHEN k % 17 = 0 THEN 'purpose' WHEN k % 19 = 0 THEN 'rate' WHEN k % 23 = 0 THEN 'rightsholder'
  WHEN shown = 'framed' THEN 'display_mode' WHEN k % 29 = 0 THEN 'evidence_url' WHEN k % 7 = 0 THEN 'uses' WHEN shown = 'none' THEN 'display' {uses}
  WHEN k % 13 = 0 AND k % 5 = 0 THEN 'retention_days' WHEN (k % 2 = 0 OR shown = 'attributed') AND k % 3 = 0 THEN 'attribution' WHEN shown = 'attributed' AND k % 2 <> 0 THEN 'attribution' END"""


@query(f"""WITH {_G}, v AS (SELECT scope, coalesce(CASE WHEN scope <> 'bibliography' THEN 'scope' END, {_denied_sql("")},
  CASE WHEN since > TIMESTAMP '1997-01-01' THEN 'not_effective' WHEN until <= TIMESTAMP '1997-01-01' THEN 'expired' WHEN NOT list_has_all(allowed, ['title', 'url', 'price']) THEN 'fields' ELSE 'allowed' END) AS verdict FROM h)
SELECT scope, verdict, count(*) AS n FROM v GROUP BY ALL""")
def grants_decided(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each grant fails, asked for titles, addresses and prices to be collected and shown."""
    reason = grants.denial(F.col("source_id"), F.lit(" api "), F.lit("bibliography"), grants.names("Title", "url", " price"), grants.names("collect", "catalog_display"), F.lit("1997-01-01").cast("timestamp"))
    return order_grants(spark, d).groupBy("scope", F.coalesce(reason, F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("n"))


_NEEDS = """n AS (SELECT l_suppkey % 10 + 1 AS source_id, l_shipdate AS moment, CASE WHEN l_returnflag = 'N' OR l_linenumber = 6 THEN 'used_prices' WHEN l_quantity > 5 OR l_linenumber = 3 THEN 'current_prices' ELSE 'bibliography' END AS scope,
  list_filter(['title', 'url', 'format', 'observed_at', 'availability', CASE WHEN l_quantity > 5 THEN 'price' END, CASE WHEN l_quantity > 5 THEN 'currency' END, CASE WHEN l_quantity > 5 THEN 'price_basis' END, CASE WHEN l_linestatus = 'F' AND l_linenumber > 5 THEN 'condition' END], lambda x: x IS NOT NULL) AS fields FROM lineitem)"""


def needs(spark: SparkSession, d: str) -> DataFrame:
    """What each observation needs a grant for."""
    l, none, listed = T.table(spark, d, "lineitem"), F.lit(""), F.expr("cast(null as array<struct<basis:string>>)")
    status = F.when(F.col("l_returnflag") == "N", "Sold ").when(F.col("l_returnflag") == "A", "active").otherwise("ended")
    basis = F.when(F.col("l_linenumber") == 6, " Used_asking").otherwise("")
    price = F.when(F.col("l_quantity") > 5, F.col("l_extendedprice"))
    condition = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 5), "good").otherwise(" ")
    return l.select(
        (F.col("l_suppkey") % 10 + 1).alias("source_id"), F.col("l_shipdate").cast("timestamp").alias("captured_at"), grants.observation_scope(status, basis, price, listed, F.when(F.col("l_linenumber") == 3, "fixed"), none).alias("scope"),
        grants.observation_fields(status, none, none, none, price, listed, condition, none, none, none).alias("fields"),
    )


@query(f"WITH {_NEEDS} SELECT scope, array_to_string(fields, ',') AS fields, count(*) AS n FROM n GROUP BY ALL")
def observation_needs(spark: SparkSession, d: str) -> DataFrame:
    return needs(spark, d).groupBy("scope", F.array_join("fields", ",").alias("fields")).agg(F.count("*").alias("n"))


@query(f"""WITH {_G}, {_NEEDS}, c AS (SELECT source_id, scope, moment, list_sort(list_distinct(flatten(list(fields)))) AS fields FROM n GROUP BY ALL),
a AS (SELECT * FROM (SELECT *, {_denied_sql("WHEN k % 13 = 0 THEN 'retention'")} AS denied FROM h) WHERE denied IS NULL AND since <= TIMESTAMP '{NOW}' AND (until IS NULL OR until > TIMESTAMP '{NOW}')),
s AS (SELECT DISTINCT source_id, scope, fields FROM c), w AS (SELECT DISTINCT s.* FROM s JOIN a ON a.source_id = s.source_id AND a.scope = s.scope AND list_has_all(a.allowed, s.fields)),
v AS (SELECT c.source_id, c.scope, c.moment, CASE WHEN c.moment > TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE THEN 'future' WHEN w.source_id IS NULL THEN 'no_grant'
  WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = c.source_id AND a.scope = c.scope AND greatest(a.since, a.reviewed) <= c.moment AND (a.until IS NULL OR c.moment < a.until) AND list_has_all(a.allowed, c.fields)) THEN 'not_then' ELSE 'authorized' END AS verdict
  FROM c LEFT JOIN w ON w.source_id = c.source_id AND w.scope = c.scope AND w.fields = c.fields)
SELECT source_id, scope, verdict, count(*) AS captures, min(moment) AS first_at, max(moment) AS last_at FROM v GROUP BY source_id, scope, verdict""")
def captures_authorized(spark: SparkSession, d: str) -> DataFrame:
    """Captures whose fields one grant allows both now and at the time of capture."""
    c = needs(spark, d).distinct().select("source_id", "scope", "captured_at", F.explode("fields").alias("field"))
    sources = spark.range(1, 11).select(F.col("id").alias("source_id"), F.lit("api ").alias("method"))
    v = grants.authorized(c, order_grants(spark, d), sources, F.lit(NOW).cast("timestamp"))
    first, last = F.min("captured_at").cast("timestamp_ntz").alias("first_at"), F.max("captured_at").cast("timestamp_ntz").alias("last_at")
    return v.groupBy("source_id", "scope", "verdict").agg(F.count("*").alias("captures"), first, last)


# --- evidence of records ---------------------------------------------------------------------------------------------

_RECORDS = f"""{with_tables("works", "editions", "credits")},
c AS (SELECT work_id, list(DISTINCT CAST(person_id AS VARCHAR)) FILTER (WHERE role = 'featured') AS featured, list(DISTINCT CAST(person_id AS VARCHAR)) FILTER (WHERE role = 'cover_model') AS cover FROM credits GROUP BY work_id),
r AS (SELECT edition_id AS rid, 'w' || e.work_id AS wid, 'e' || edition_id AS eid, 'https://' || format || '.example/' || edition_id AS meta, title, publication_type, issue_month, isbn, edition_publisher, size, publication_date, store_date, release_date,
  coalesce(featured, []) AS featured, coalesce(cover, []) AS cover, format, work_status FROM editions e JOIN works w ON w.work_id = e.work_id LEFT JOIN c ON c.work_id = e.work_id)"""
_EXPECTED = """x AS (
  SELECT rid, 'work' AS et, wid AS eid, unnest(list_filter(['title', 'origin', CASE WHEN publication_type <> '' THEN 'publication_type' END, CASE WHEN issue_month <> '' THEN 'issue_month' END], lambda f: f IS NOT NULL)) AS field, 'bibliography' AS scope, meta AS url FROM r
  UNION ALL SELECT rid, 'work', wid, 'featured_names', 'bibliography', 'https://credits.example/' || rid FROM r WHERE len(featured) > 0
  UNION ALL SELECT rid, 'edition', eid, unnest(list_filter(['metadata_source_url', 'format', 'publisher', CASE WHEN isbn <> '' THEN 'isbn' END, CASE WHEN size <> 0 THEN 'page_count' END], lambda f: f IS NOT NULL)), 'bibliography', meta FROM r
  UNION ALL SELECT rid, 'edition', eid, unnest(['release_date', 'release_precision']), 'bibliography', meta FROM r WHERE release_date IS NOT NULL
  UNION ALL SELECT rid, 'edition', eid, unnest(['publication_date', 'publication_date_precision']), 'bibliography', 'https://dates.example/p' FROM r WHERE publication_date IS NOT NULL
  UNION ALL SELECT rid, 'edition', eid, unnest(['store_release_date', 'store_release_date_precision']), 'bibliography', 'http://dates.example/s' FROM r WHERE store_date IS NOT NULL
  UNION ALL SELECT rid, 'work_image', wid, 'cover_url', 'product_images', meta FROM r WHERE format = 'digital'
  UNION ALL SELECT rid, 'person', unnest(featured), 'identity', 'bibliography', 'https://people.example/' FROM r
  UNION ALL SELECT rid, 'work_credit', wid, 'featured:' || unnest(featured), 'bibliography', 'https://credits.example/' || rid FROM r
  UNION ALL SELECT rid, 'person', unnest(cover), 'identity', 'bibliography', 'https://people.example/' FROM r
  UNION ALL SELECT rid, 'work_credit', wid, 'cover:' || unnest(cover), 'bibliography', meta FROM r
  UNION ALL SELECT rid, 'edition_image', eid, 'sample', 'product_images', 'https://media.example/' || rid FROM r WHERE size > 40),
p AS (
  SELECT rid, 'work' AS et, wid AS eid, unnest(['title', 'origin', ' publication_type ']) AS field, 'bibliography' AS scope, meta AS url FROM r
  UNION ALL SELECT rid, 'edition', eid, unnest(['metadata_source_url', 'format', 'publisher', 'isbn', 'page_count']), CASE WHEN size = 7 THEN 'used_prices' ELSE 'bibliography' END, meta FROM r
  UNION ALL SELECT rid, 'edition', eid, unnest(['publication_date', 'publication_date_precision']), 'bibliography', CASE WHEN size % 9 = 0 THEN 'https://other.example/' ELSE 'https://dates.example/p' END FROM r WHERE publication_date IS NOT NULL
  UNION ALL SELECT rid, 'person', unnest(featured), 'identity', 'bibliography', 'https://people.example/' FROM r
  UNION ALL SELECT rid, 'work_image', wid, unnest(CASE WHEN work_status = 'published' THEN ['cover_url'] ELSE ['cover_url', 'cover_url'] END), 'product_images', meta FROM r WHERE format = 'digital')"""


def nested_records(spark: SparkSession, d: str) -> DataFrame:
    """Editions with their works, people and evidence as nested import records."""
    people = T.credits(spark, d).groupBy("work_id", "role").agg(F.array_sort(F.collect_set(F.col("person_id").cast("string"))).alias("p"))
    featured = people.where("role = 'featured'").select("work_id", F.col("p").alias("featured"))
    cover = people.where("role = 'cover_model'").select("work_id", F.col("p").alias("cover"))
    none = F.expr("cast(array() as array<string>)")
    r = T.editions(spark, d).join(T.works(spark, d), "work_id").join(featured, "work_id", "left").join(cover, "work_id", "left")
    r = r.withColumns({"featured": F.coalesce("featured", none), "cover": F.coalesce("cover", none), "wid": F.concat(F.lit("w"), F.col("work_id").cast("string")), "eid": F.concat(F.lit("e"), F.col("edition_id").cast("string"))})
    rid = F.col("edition_id").cast("string")
    meta = F.concat(F.lit("https://"), "format", F.lit(".example/"), rid)
    person = lambda s: F.struct(s.alias("slug"), F.lit("https://people.example/").alias("verification_source_url"))
    stamp = lambda c: F.col(c).cast("timestamp")

    def piece(entity: str, eid: str, scope, url, fields):
        return F.struct(F.lit(entity).alias("entity_type"), F.col(eid).alias("entity_id"), F.lit("s1").alias("source_id"), scope.alias("scope"), url.alias("source_url"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"), fields.alias("fields"))

    text, pictures = F.lit("bibliography"), F.lit("product_images")
    dates = F.when(F.col("publication_date").isNotNull(), piece("edition", "eid", text, F.when(F.col("size") % 9 == 0, "https://other.example/").otherwise("https://dates.example/p"), grants.names("publication_date", "publication_date_precision")))
    covers = F.when(F.col("work_status") == "published", grants.names("cover_url")).otherwise(grants.names("cover_url", "cover_url"))
    given = F.array(
        piece("work", "wid", text, meta, grants.names("title", "origin", " publication_type ")),
        piece("edition", "eid", F.when(F.col("size") == 7, "used_prices").otherwise(text), meta, grants.names("metadata_source_url", "format", "publisher", "isbn", "page_count")),
        dates, F.when(F.col("format") == "digital", piece("work_image", "wid", pictures, meta, covers)),
    )
    who = F.transform("featured", lambda s: F.struct(F.lit("person").alias("entity_type"), s.alias("entity_id"), F.lit("s1").alias("source_id"), text.alias("scope"), F.lit("https://people.example/").alias("source_url"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"), grants.names("identity").alias("fields")))
    work = F.struct(
        F.col("wid").alias("id"), "title", F.lit("").alias("origin"), F.lit(" ").alias("english_title"), "publication_type", "issue_month", F.array_join("featured", ", ").alias("featured_names"),
        F.when(F.col("format") == "digital", F.concat(meta, F.lit("/cover"))).alias("cover_url"),
    )
    edition = F.struct(
        F.col("eid").alias("id"), F.col("wid").alias("work_id"), meta.alias("metadata_source_url"), "format", F.col("edition_publisher").alias("publisher"), "isbn", F.col("size").alias("page_count"),
        stamp("release_date").alias("release_date"), F.when(F.col("release_date").isNotNull(), "day").alias("release_precision"), stamp("publication_date").alias("publication_date"), F.lit("day").alias("publication_date_precision"),
        F.lit("https://dates.example/p").alias("publication_date_source_url"), stamp("store_date").alias("store_release_date"), F.lit("day").alias("store_release_date_precision"), F.lit("http://dates.example/s").alias("store_release_date_source_url"),
    )
    media = F.when(F.col("size") > 40, F.array(F.struct(F.lit("sample").alias("media_type"), F.concat(F.lit("https://media.example/"), rid).alias("source_url"))))
    return r.select(
        F.col("edition_id").alias("record_id"), work.alias("work"), edition.alias("edition"), F.transform("featured", person).alias("featured_people"), F.transform("cover", person).alias("cover_people"), media.alias("edition_media"),
        F.concat(F.lit("https://credits.example/"), rid).alias("featured_credit_source_url"), F.lit(" ").alias("cover_credit_source_url"), F.concat(F.array_compact(given), who).alias("source_evidence"),
    )


@query(f"""{_RECORDS}, {_EXPECTED},
e AS (SELECT rid, et, eid, field, min(scope) AS scope, min(url) AS url, min(url) NOT LIKE 'https://%' AS unsourced, count(DISTINCT (scope, url)) > 1 AS differs FROM x GROUP BY rid, et, eid, field),
q AS (SELECT rid, et, eid, trim(field) AS field, min(scope) AS scope, min(url) AS url, count(*) AS n FROM p GROUP BY rid, et, eid, trim(field)),
g AS (SELECT coalesce(e.rid, q.rid) AS record_id, coalesce(e.et, q.et) AS entity_type, coalesce(e.eid, q.eid) AS entity_id, coalesce(e.field, q.field) AS field,
  CASE WHEN n > 1 THEN 'duplicate' WHEN e.rid IS NULL THEN 'extra' WHEN unsourced THEN 'unsourced' WHEN differs THEN 'conflict' WHEN q.rid IS NULL THEN 'missing' WHEN e.url <> q.url THEN 'url' WHEN e.scope <> q.scope THEN 'scope' END AS gap
  FROM e FULL JOIN q ON e.rid = q.rid AND e.et = q.et AND e.eid = q.eid AND e.field = q.field)
SELECT * FROM g WHERE gap IS NOT NULL""")
def record_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Where the evidence of each nested record isn't what its filled fields need."""
    return evidence.evidence_mismatches(nested_records(spark, d))


# --- reviewed merges -------------------------------------------------------------------------------------------------

_CHAINS = f"""{with_tables("works", "credits", "people")},
w AS (SELECT work_id, title, publisher, size, work_status, lag(work_id) OVER (PARTITION BY title, publisher ORDER BY work_id) AS before FROM works),
g AS (SELECT work_id AS group_id, before, CASE WHEN size = 13 THEN 'person' WHEN size % 10 = 0 THEN 'edition' END AS waits FROM w WHERE before IS NOT NULL),
i AS (SELECT w.*, sum(CASE WHEN g.group_id IS NULL OR waits IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY title, publisher ORDER BY w.work_id) AS island FROM w LEFT JOIN g ON g.group_id = w.work_id),
m AS (SELECT work_id, min(work_id) OVER (PARTITION BY title, publisher, island) AS kept, waits FROM i LEFT JOIN g ON g.group_id = i.work_id),
c AS (SELECT kept, count(DISTINCT (person_id, role)) AS credits FROM credits JOIN m USING (work_id) GROUP BY kept)"""


@query(f"""{_CHAINS}, e AS (SELECT kept, count(*) AS editions, count(*) // 2 - 1 AS members FROM m, (VALUES (0), (1)) AS t(k) GROUP BY kept)
SELECT kept AS work_id, members, editions, coalesce(credits, 0) AS credits, (SELECT count(*) FROM m WHERE waits = 'edition') AS waiting_editions, (SELECT count(*) FROM m WHERE waits = 'person') AS waiting_people
FROM e LEFT JOIN c USING (kept) WHERE members > 0""")
def work_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Each work merges into the one of its title and publisher before it: chains end at the first, and break where a group waits."""
    before = F.lag("work_id").over(Window.partitionBy("title", "publisher").orderBy("work_id"))
    w = T.works(spark, d)
    g = w.withColumn("before", before).where("before IS NOT NULL").select(
        F.col("work_id").alias("group_id"), F.col("before").alias("work_id"), F.when(F.col("size") == 13, -1).otherwise(1).cast("long").alias("person_id"), F.col("work_id").alias("member_id"),
        F.when((F.col("size") % 10 == 0) & (F.col("size") != 13), -1).otherwise(F.col("work_id") * 2).cast("long").alias("edition_id"),
    )
    people = spark.range(1, 2).select(F.col("id").alias("person_id"))
    works = w.select("work_id", F.col("work_status").alias("status"), F.array("publisher").alias("featured_names"))
    out = merging.merge_works(spark, works, T.editions(spark, d).select("edition_id", "work_id"), T.credits(spark, d), people, g)
    kept = out.targets.groupBy(F.col("into").alias("work_id")).agg(F.count("*").alias("members"))
    e = out.editions.groupBy("work_id").agg(F.count("*").alias("editions"))
    c = out.credits.groupBy("work_id").agg(F.count("*").alias("credits"))
    waits = out.deferred.agg(*(F.count_if(F.col("reason") == x).alias(x) for x in ("edition", "person"))).first()
    df = kept.join(e, "work_id").join(c, "work_id", "left")
    return df.select("work_id", "members", "editions", F.coalesce("credits", F.lit(0)).alias("credits"), F.lit(waits["edition"]).cast("long").alias("waiting_editions"), F.lit(waits["person"]).cast("long").alias("waiting_people"))


# --- import manifests ------------------------------------------------------------------------------------------------

_ITEMS = f"""{with_tables("works", "editions", "credits", "listings")},
c AS (SELECT work_id, list_sort(list(DISTINCT CASE WHEN person_id % 50 = 0 THEN '' ELSE CAST(person_id AS VARCHAR) END) FILTER (WHERE role = 'featured')) AS featured, list_sort(list(DISTINCT CASE WHEN person_id % 50 = 0 THEN '' ELSE CAST(person_id AS VARCHAR) END) FILTER (WHERE role = 'cover_model')) AS cover FROM credits GROUP BY work_id),
l AS (SELECT edition_id, list({{'own': quantity % 11 <> 0, 'status': status, 'basis': CASE quantity % 5 WHEN 0 THEN 'sale' WHEN 1 THEN 'list' ELSE '' END, 'price': price_minor}}) AS items FROM listings WHERE edition_id IS NOT NULL GROUP BY edition_id),
r AS (SELECT e.edition_id AS k, e.work_id AS w, e.format, title, publication_type, issue_month, publication_date, store_date, release_date, coalesce(featured, []) AS featured, coalesce(cover, []) AS cover, coalesce(items, []) AS items,
  ['JP', 'KR', 'XX'][e.work_id % 3 + 1] AS origin FROM editions e JOIN works USING (work_id) LEFT JOIN c USING (work_id) LEFT JOIN l ON l.edition_id = e.edition_id)"""


@query(f"""{_ITEMS}, p AS (SELECT k, unnest(list_filter([CASE WHEN list_contains(featured, '') OR (w % 13 = 0 AND len(featured) > 0) THEN 'featured_people' END, CASE WHEN k % 4 = 3 THEN 'credit_source' END, CASE WHEN list_contains(cover, '') THEN 'cover_people' END,
  CASE WHEN w % 29 = 0 THEN 'publication_type' END, CASE WHEN w % 29 <> 0 AND publication_type = 'magazine_issue' AND (NOT regexp_matches(issue_month, '^[0-9]{{4}}-(0[1-9]|1[0-2])$') OR len(cover) = 0 OR cover[1] = '') THEN 'issue_identity' END,
  CASE WHEN (w % 29 = 0 OR publication_type = 'photobook') AND (len(featured) = 0 OR array_to_string(featured, '') = '' OR issue_month <> '') THEN 'photobook_identity' END,
  CASE WHEN (publication_date IS NOT NULL AND k % 7 = 0) OR (publication_date IS NULL AND k % 7 <> 0) THEN 'publication_date' END, CASE WHEN store_date IS NOT NULL THEN 'store_release_date' END,
  CASE WHEN origin = 'KR' AND release_date IS NOT NULL THEN 'ambiguous_release_date' END, CASE WHEN w % 31 = 0 OR origin = 'XX' OR k % 17 = 0 THEN 'catalog_identity' END, CASE WHEN k % 23 = 0 THEN 'format' END,
  CASE WHEN k % 5 = 1 THEN 'warning_cover' END, CASE WHEN len(items) > 0 AND k % 19 = 0 THEN 'source_mismatch' END, CASE WHEN len(list_filter(items, lambda x: NOT x.own OR k % 23 = 0)) > 0 THEN 'listing_mismatch' END,
  CASE WHEN len(list_filter(items, lambda x: (x.basis <> '' AND x.status = 'completed') OR (origin = 'KR' AND x.price > 0 AND x.basis = ''))) > 0 THEN 'price' END], lambda x: x IS NOT NULL)) AS problem FROM r)
SELECT problem, count(*) AS records, min(k) AS first_record FROM p GROUP BY problem""")
def import_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Editions with their people and listings as import records, and the rules that they break."""
    slug = F.when(F.col("person_id") % 50 == 0, "").otherwise(F.col("person_id").cast("string"))
    people = T.credits(spark, d).groupBy("work_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("role") == r, slug))).alias(n) for r, n in (("featured", "featured"), ("cover_model", "cover"))))
    basis = F.when(F.col("quantity") % 5 == 0, "sale").when(F.col("quantity") % 5 == 1, "list").otherwise("")
    none = F.expr("cast(null as array<struct<basis:string,price_minor:bigint,currency:string,condition:string>>)")
    own = F.when(F.col("quantity") % 11 == 0, F.col("edition_id") + 1).otherwise(F.col("edition_id")).cast("string")
    item = F.struct(own.alias("edition_id"), "format", "status", "currency", basis.alias("price_basis"), "price_minor", none.alias("price_components"))
    listed = T.listings(spark, d).where("edition_id IS NOT NULL").groupBy("edition_id").agg(F.collect_list(item).alias("items"))
    r = T.editions(spark, d).join(T.works(spark, d), "work_id").join(people, "work_id", "left").join(listed, "edition_id", "left")
    k, w, empty = F.col("edition_id"), F.col("work_id"), F.expr("cast(array() as array<string>)")
    featured, cover = F.coalesce("featured", empty), F.coalesce("cover", empty)
    twice = F.when((w % 13 == 0) & (F.size(featured) > 0), F.concat(featured, F.slice(featured, 1, 1))).otherwise(featured)
    person = lambda s: F.struct(s.alias("slug"), F.lit("https://people.example/p").alias("verification_source_url"))
    text, stamp, no_day = F.lit("").alias, lambda c: F.col(c).cast("timestamp"), F.lit(None).cast("timestamp")
    dated = k % 7 != 0
    work = F.struct(
        w.cast("string").alias("id"), F.when(w % 31 == 0, F.concat("title", F.lit(" ??"))).otherwise(F.col("title")).alias("title"), _pick(w, "JP", "KR", "XX").alias("origin"), F.when(w % 29 == 0, "poster").otherwise(F.col("publication_type")).alias("publication_type"),
        "issue_month", text("issue_number"), F.array_join(featured, "").alias("featured_names"), text("cover_url"), no_day.alias("issue_date"), text("issue_date_precision"), text("issue_date_source_url"),
    )
    edition = F.struct(
        k.cast("string").alias("id"), w.cast("string").alias("work_id"), F.when(k % 17 == 0, " ").otherwise("https://meta.example/").alias("metadata_source_url"), F.when(k % 23 == 0, "vinyl").otherwise(F.col("format")).alias("format"),
        F.when(k % 5 == 1, "https://a.example/Restricted.jpg?w=1").when(k % 5 == 2, "").otherwise("https://a.example/x.jpg").alias("cover_url"),
        text("cover_object_key"), F.when(k % 5 == 2, "https://a.example/p_mask.png").otherwise("").alias("original_cover_url"), stamp("release_date").alias("release_date"),
        stamp("publication_date").alias("publication_date"), F.when(dated, "day").otherwise("").alias("publication_date_precision"), F.when(dated, "https://dates.example/").otherwise("").alias("publication_date_source_url"),
        stamp("store_date").alias("store_release_date"), text("store_release_date_precision"), text("store_release_date_source_url"),
    )
    records = r.select(
        k.alias("record_id"), work.alias("work"), edition.alias("edition"), F.transform(twice, person).alias("featured_people"), F.transform(cover, person).alias("cover_people"), _pick(k, "", "verified_publisher_source", "verified_model_capture", "rumour").alias("featured_credit_source"),
        F.lit("s1").alias("source_id"), F.when(k % 19 == 0, "s2").otherwise("s1").alias("batch_source_id"), "items",
    )
    return manifest.manifest_problems(records).groupBy("problem").agg(F.count("*").alias("records"), F.min("record_id").alias("first_record"))


# --- what was imported -----------------------------------------------------------------------------------------------

_IMPORTED = f"""{with_tables("listings", "editions")},
x AS (SELECT source_id, external_id AS ext, CASE WHEN quantity = 3 THEN price_minor + 1 ELSE price_minor END AS price, CASE WHEN quantity = 4 THEN 'EUR' ELSE currency END AS cur, CASE WHEN quantity = 5 THEN 'digital' ELSE format END AS fmt, CAST(quantity % 3 AS INT) AS media,
    CASE WHEN quantity % 4 = 0 THEN 2 ELSE 0 END AS pub, CASE WHEN quantity = 6 THEN edition_id + 2 ELSE edition_id END AS eid, work_id AS wid, quantity % 10 = 0 AS excluded, CASE WHEN edition_id % 6 = 0 THEN DATE '2000-01-01' + CAST(edition_id % 6000 AS INT) + CAST(quantity = 7 AS INT) END AS day FROM listings WHERE work_id % 3 = 0
  UNION ALL SELECT source_id, external_id || 'x', price_minor, currency, format, 0, 0, edition_id, work_id, false, NULL FROM listings WHERE work_id % 300 = 1),
j AS (SELECT x.*, l.listing_id, l.price_minor, l.currency, l.format, l.edition_id, l.status, l.line, e.work_id AS e_work, e.release_date FROM x LEFT JOIN listings l ON l.source_id = x.source_id AND l.external_id = x.ext LEFT JOIN editions e ON e.edition_id = l.edition_id)"""


def _imported(spark: SparkSession, d: str) -> DataFrame:
    """A manifest beside what is stored; a listing's line stands for its pictures, its edition's number for the publisher's."""
    l, q = T.listings(spark, d), F.col("quantity")
    release = F.when(F.col("edition_id") % 6 == 0, F.date_add(F.lit("2000-01-01").cast("date"), (F.col("edition_id") % 6000 + (q == 7).cast("int")).cast("int")))
    x = l.where("work_id % 3 = 0").select(
        "source_id", F.col("external_id").alias("ext"), F.when(q == 3, F.col("price_minor") + 1).otherwise(F.col("price_minor")).alias("price"), F.when(q == 4, "EUR").otherwise(F.col("currency")).alias("cur"),
        F.when(q == 5, "digital").otherwise(F.col("format")).alias("fmt"), (q % 3).cast("int").alias("media"), F.when(q % 4 == 0, 2).otherwise(0).alias("pub"), F.when(q == 6, F.col("edition_id") + 2).otherwise(F.col("edition_id")).alias("eid"),
        F.col("work_id").alias("wid"), (q % 10 == 0).alias("excluded"), release.alias("day"),
    )
    more = l.where("work_id % 300 = 1").select("source_id", F.concat("external_id", F.lit("x")), "price_minor", "currency", "format", F.lit(0), F.lit(0), "edition_id", "work_id", F.lit(False), F.lit(None).cast("date"))
    stored = l.select(F.col("source_id").alias("s"), F.col("external_id").alias("e"), "listing_id", "price_minor", "currency", "format", "edition_id", "status", "line")
    e = T.editions(spark, d).select(F.col("edition_id").alias("e_id"), F.col("work_id").alias("e_work"), "release_date")
    x = x.union(more)
    return x.join(stored, (F.col("source_id") == F.col("s")) & (F.col("ext") == F.col("e")), "left").join(e, F.col("edition_id") == F.col("e_id"), "left")


def _import_checks() -> dict:
    """{name: whether an expected row fails}: null-safe, and only what the row is meant to have."""
    found, same = F.col("listing_id").isNotNull(), lambda a, b: F.col(a).eqNullSafe(F.col(b))
    linked = ~F.col("excluded") & F.col("eid").isNotNull()
    return {
        "price_mismatches": found & ~(same("price_minor", "price") & same("currency", "cur")), "format_mismatches": found & ~same("format", "fmt"), "release_date_mismatches": linked & ~same("release_date", "day"),
        "missing_media": found & (F.col("line") < F.col("media")), "missing_publisher_media": (F.col("pub") > 0) & (F.coalesce(F.col("eid") % 3, F.lit(0)) < F.col("pub")), "linked_editions": F.col("edition_id").isNotNull(),
        "work_mismatches": linked & ~(same("edition_id", "eid") & same("e_work", "wid")), "exclusion_mismatches": F.col("excluded") & (~F.col("status").eqNullSafe(F.lit("excluded")) | F.col("edition_id").isNotNull()),
    }


@query(f"""{_IMPORTED} SELECT count(*) AS expected, count(listing_id) AS present, count(*) FILTER (WHERE listing_id IS NOT NULL AND (price_minor IS DISTINCT FROM price OR currency IS DISTINCT FROM cur)) AS price_mismatches,
  count(*) FILTER (WHERE listing_id IS NOT NULL AND format IS DISTINCT FROM fmt) AS format_mismatches, count(*) FILTER (WHERE NOT excluded AND eid IS NOT NULL AND release_date IS DISTINCT FROM day) AS release_date_mismatches,
  count(*) FILTER (WHERE listing_id IS NOT NULL AND line < media) AS missing_media, count(*) FILTER (WHERE pub > 0 AND coalesce(eid % 3, 0) < pub) AS missing_publisher_media, count(edition_id) AS linked_editions,
  count(*) FILTER (WHERE NOT excluded AND eid IS NOT NULL AND (edition_id IS DISTINCT FROM eid OR e_work IS DISTINCT FROM wid)) AS work_mismatches, count(*) FILTER (WHERE excluded AND (status IS DISTINCT FROM 'excluded' OR edition_id IS NOT NULL)) AS exclusion_mismatches FROM j""")
def import_counters(spark: SparkSession, d: str) -> DataFrame:
    """All ten counters of an import's verification from one pass."""
    return _imported(spark, d).agg(F.count("*").alias("expected"), F.count("listing_id").alias("present"), *(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in _import_checks().items()))


@query(f"""{_IMPORTED} SELECT 'release_date' AS issue, source_id, ext, eid, edition_id, wid, e_work FROM j WHERE NOT excluded AND eid IS NOT NULL AND release_date IS DISTINCT FROM day
UNION ALL SELECT 'work', source_id, ext, eid, edition_id, wid, e_work FROM j WHERE NOT excluded AND eid IS NOT NULL AND (edition_id IS DISTINCT FROM eid OR e_work IS DISTINCT FROM wid)""")
def import_issues(spark: SparkSession, d: str) -> DataFrame:
    """The rows behind two of the counters: expected and stored editions and works."""
    checks = _import_checks()
    issue = F.explode(F.array_compact(F.array(*(F.when(checks[k], F.lit(n)) for k, n in (("release_date_mismatches", "release_date"), ("work_mismatches", "work"))))))
    return _imported(spark, d).select(issue.alias("issue"), "source_id", "ext", "eid", "edition_id", "wid", "e_work")


@query(f"""{with_tables("listings", "editions")}, o AS (SELECT l.*, e.work_id AS e_work, e.format AS e_format, quantity % 17 = 0 AS excluded FROM listings l LEFT JOIN editions e USING (edition_id)),
i AS (SELECT unnest(list_filter([CASE WHEN quantity % 13 = 0 THEN 'batch_source_mismatch' END, CASE WHEN NOT excluded AND (quantity % 9 = 0 OR price_minor <= 0) THEN 'missing_or_nonpositive_paid_price' END, CASE WHEN currency <> 'JPY' THEN 'unexpected_currency' END,
    CASE WHEN quantity % 7 = 0 THEN 'missing_cover' END, CASE WHEN format = 'digital' AND NOT authorized THEN 'unverified_digital_store' END, CASE WHEN edition_id IS NOT NULL AND (e_work IS DISTINCT FROM work_id OR quantity % 11 = 0 OR e_format IS DISTINCT FROM format) THEN 'catalog_identity_mismatch' END,
    CASE WHEN line % 5 = 4 THEN 'listing_media_source_mismatch' END, CASE WHEN line % 5 = 3 AND edition_id IS NOT NULL THEN 'publisher_media_source_mismatch' END], lambda x: x IS NOT NULL)) AS issue FROM o),
s AS (SELECT source_id, work_id FROM o GROUP BY ALL HAVING count(DISTINCT (format, price_minor, currency)) > 1), c AS (SELECT thread FROM o WHERE edition_id IS NOT NULL GROUP BY thread HAVING count(DISTINCT edition_id) > 3)
SELECT issue, count(*) AS n FROM i GROUP BY issue UNION ALL SELECT 'shared_offer_values_differ', count(*) FROM s UNION ALL SELECT 'edition_identity_conflict', count(*) FROM c""")
def capture_quality(spark: SparkSession, d: str) -> DataFrame:
    """Eight rules of single captures and two across captures: one pass and two groupings."""
    e = T.editions(spark, d).select(F.col("edition_id").alias("e_id"), F.col("work_id").alias("e_work"), F.col("format").alias("e_format"))
    o, q, line = T.listings(spark, d).join(e, F.col("edition_id") == F.col("e_id"), "left"), F.col("quantity"), F.col("line")
    linked, item_edition = F.col("edition_id").isNotNull(), F.when(q % 11 == 0, F.col("edition_id") + 1).otherwise(F.col("edition_id"))
    page, media = F.concat(F.lit("https://shop.example/"), "listing_id"), F.when(line % 5 == 4, F.lit("https://other.example/")).otherwise(F.concat(F.lit("https://shop.example/"), "listing_id"))
    meta, given = F.lit("https://press.example/"), F.when(line % 5 == 3, F.lit("https://other.example/")).otherwise(F.lit("https://press.example/"))
    paid = F.when(q % 9 != 0, F.col("price_minor"))
    rules = {
        "batch_source_mismatch": F.when(q % 13 == 0, F.col("source_id") + 1).otherwise(F.col("source_id")) != F.col("source_id"), "missing_or_nonpositive_paid_price": (q % 17 != 0) & ~F.coalesce(paid > 0, F.lit(False)), "unexpected_currency": F.col("currency") != "JPY",
        "missing_cover": F.when(q % 7 == 0, "").otherwise("https://img.example/") == "", "unverified_digital_store": (F.col("format") == "digital") & ~F.col("authorized"),
        "catalog_identity_mismatch": linked & ~(F.col("e_work").eqNullSafe(F.col("work_id")) & item_edition.eqNullSafe(F.col("edition_id")) & F.col("e_format").eqNullSafe(F.col("format"))), "listing_media_source_mismatch": media != page, "publisher_media_source_mismatch": linked & (given != meta),
    }
    single = o.select(F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    named = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    shared = o.groupBy("source_id", "work_id").agg(F.countDistinct("format", "price_minor", "currency").alias("k")).where("k > 1")
    torn = o.where(linked).groupBy("thread").agg(F.countDistinct("edition_id").alias("k")).where("k > 3")
    return single.unionByName(named(shared, "shared_offer_values_differ")).unionByName(named(torn, "edition_identity_conflict"))
