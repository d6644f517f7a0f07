"""Ingestion, projections, identity resolution and permissions over the catalog's stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import ids, offers, rules, texts
from bindery.operators import lifecycle, permissions, upsert
from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry, with_tables

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)
OBS = with_tables("observations")
LATEST = "observed_at DESC, work_id DESC, price_minor DESC, status DESC, quantity DESC"


@query(f"""{OBS} SELECT thread, listing_id, observed_at, status, price_minor FROM observations
QUALIFY row_number() OVER (PARTITION BY thread ORDER BY {LATEST}, listing_id) = 1""")
def latest_observation_per_listing(spark: SparkSession, d: str) -> DataFrame:
    df = upsert.keep_first(T.observations(spark, d), ["thread"], [*T.newest(), "listing_id"])
    return df.select("thread", "listing_id", "observed_at", "status", "price_minor")


@query(f"""{OBS}, old AS (SELECT listing_id, price_minor, status, CASE WHEN quantity > 25 THEN status ELSE '' END AS note FROM observations WHERE line % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY {LATEST}) = 1),
new AS (SELECT listing_id, price_minor, status, CASE WHEN quantity > 40 THEN 'many' ELSE '' END AS note FROM observations WHERE line % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY {LATEST}) = 1)
SELECT coalesce(n.listing_id, o.listing_id) AS listing_id, CASE WHEN n.listing_id IS NULL THEN o.price_minor ELSE n.price_minor END AS price_minor,
  CASE WHEN n.listing_id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.listing_id IS NULL THEN o.note ELSE coalesce(nullif(n.note, ''), o.note) END AS note
FROM old o FULL JOIN new n ON o.listing_id = n.listing_id""")
def listing_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """A batch folded into the listings: the latest of each id wins, but a blank note leaves the old one."""
    o = T.observations(spark, d)
    note = lambda df, c: df.select("listing_id", "price_minor", "status", c.alias("note"), "observed_at", "work_id", "quantity")
    old = note(o.where("line % 2 = 0"), F.when(F.col("quantity") > 25, F.col("status")).otherwise(""))
    old = upsert.keep_first(old, ["listing_id"], T.newest()).select("listing_id", "price_minor", "status", "note")
    batch = note(o.where("line % 3 = 0"), F.when(F.col("quantity") > 40, "many").otherwise(""))
    return upsert.upsert(old, batch, ["listing_id"], T.newest(), keep_filled=("note",))


@query(f"""{OBS}, a AS (SELECT source_id, external_id, min(observed_at) AS first_seen FROM observations WHERE line <= 4 GROUP BY source_id, external_id),
b AS (SELECT source_id, external_id, min(observed_at) AS first_seen FROM observations WHERE line >= 3 GROUP BY source_id, external_id)
SELECT substr(sha256(concat_ws(chr(0), source_id, external_id)), 1, 40) AS observation_key, first_seen FROM (
  FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (source_id, external_id))""")
def observation_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches: what the first has stays, the second adds the rest."""
    o = T.observations(spark, d).select("source_id", "external_id", "line", F.col("observed_at").alias("first_seen"))
    key = ["source_id", "external_id"]
    state = upsert.keep_first(o.where("line <= 4"), key, ["first_seen"]).drop("line")
    out = upsert.insert_absent(state, o.where("line >= 3").drop("line"), key, ["first_seen"])
    return out.select(ids.keyed("", 40, F.col("source_id").cast("string"), F.col("external_id")).alias("observation_key"), "first_seen")


_INGEST = """i AS (
  SELECT CASE WHEN line = 7 THEN '' ELSE external_id END AS external_id, CASE quantity % 6 WHEN 0 THEN 'print' WHEN 1 THEN 'E-Book' WHEN 2 THEN ' paper ' WHEN 3 THEN 'vinyl' WHEN 4 THEN '' ELSE 'pdf' END AS raw,
    status, CASE work_id % 5 WHEN 0 THEN 'digital' WHEN 1 THEN 'hammer' WHEN 2 THEN 'current' WHEN 3 THEN '' ELSE 'fixed' END AS price_type,
    CASE quantity % 7 WHEN 0 THEN 'list' WHEN 1 THEN 'sale' WHEN 2 THEN 'used_asking' WHEN 3 THEN 'completed_sale' WHEN 4 THEN 'barter' ELSE '' END AS basis, kind, source_format
  FROM observations JOIN sources USING (source_id)),
f AS (SELECT *, CASE WHEN lower(trim(raw)) IN ('physical', 'print', 'printed', 'hardcopy', 'paper') THEN 'physical'
  WHEN lower(trim(raw)) IN ('digital', 'ebook', 'e-book', 'epub', 'pdf') THEN 'digital' ELSE '' END AS stated FROM i),
g AS (SELECT *, CASE WHEN stated <> '' THEN stated WHEN price_type = 'digital' THEN 'digital' WHEN kind IN ('marketplace', 'auction') THEN 'physical' ELSE source_format END AS fmt FROM f),
r AS (SELECT *, CASE WHEN external_id = '' THEN 'missing_identity' WHEN trim(raw) <> '' AND stated = '' THEN 'unknown_format' WHEN fmt <> source_format THEN 'source_format'
  WHEN fmt = 'digital' AND status = 'completed' THEN 'digital_completed' WHEN fmt = 'digital' AND price_type NOT IN ('', 'digital') THEN 'digital_price_type'
  WHEN fmt = 'physical' AND price_type = 'digital' THEN 'physical_digital_price' WHEN price_type = 'hammer' AND status <> 'completed' THEN 'hammer_not_completed'
  WHEN price_type = 'current' AND status = 'completed' THEN 'current_completed' WHEN basis IN ('list', 'sale', 'coupon') AND status = 'completed' THEN 'retail_basis_sold'
  WHEN basis = 'used_asking' AND (fmt <> 'physical' OR status = 'completed') THEN 'used_asking' WHEN basis = 'completed_sale' AND status <> 'completed' THEN 'completed_sale_open'
  WHEN basis NOT IN ('', 'sale', 'list', 'used_asking', 'completed_sale', 'coupon') THEN 'unknown_basis' END AS reason FROM g)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Raw offers with the first reason to reject each, null where it is accepted."""
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    q = F.col("quantity")
    df = T.observations(spark, d).join(T.sources(spark, d), "source_id").select(
        F.when(F.col("line") == 7, "").otherwise(F.col("external_id")).alias("external_id"), pick(q % 6, "print", "E-Book", " paper ", "vinyl", "", "pdf").alias("raw"), "status",
        pick(F.col("work_id") % 5, "digital", "hammer", "current", "", "fixed").alias("price_type"), pick(q % 7, "list", "sale", "used_asking", "completed_sale", "barter", "", "").alias("basis"), "kind", "source_format",
    )
    df = df.withColumn("fmt", offers.effective_format(F.col("raw"), F.col("price_type"), F.col("kind")))
    reason = F.coalesce(
        F.when(F.col("external_id") == "", "missing_identity"), F.when((F.trim("raw") != "") & (offers.normal_format(F.col("raw")) == ""), "unknown_format"),
        F.when(F.col("fmt") != F.col("source_format"), "source_format"), offers.price_type_problem(F.col("fmt"), F.col("status"), F.col("price_type")),
        offers.price_basis_problem(F.col("fmt"), F.col("status"), F.col("basis")),
    )
    return df.withColumn("reason", reason)


@query(f"{with_tables('observations', 'sources')}, {_INGEST} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY reason")
def ingest_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{with_tables('observations', 'sources')}, {_INGEST} SELECT kind, count(*) AS received, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM r GROUP BY kind")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("reason").isNull()
    return judged(spark, d).groupBy("kind").agg(F.count("*").alias("received"), F.count_if(r).alias("accepted"), F.count_if(~r).alias("rejected"))


_PARTS = """c AS (
  SELECT thread, list({'basis': CASE line % 5 WHEN 0 THEN 'sale' WHEN 1 THEN 'list' WHEN 2 THEN 'used_asking' WHEN 3 THEN 'coupon' ELSE 'completed_sale' END,
    'price_minor': CASE WHEN quantity = 13 THEN NULL ELSE price_minor END, 'currency': currency, 'cond': CASE WHEN quantity % 2 = 0 THEN 'member' ELSE '' END}
    ORDER BY line, source_id, work_id, price_minor, quantity) AS c FROM observations GROUP BY thread)"""


@query(f"""{OBS}, {_PARTS}, b AS (SELECT *, list_transform(c, lambda x: x.basis) AS bs FROM c)
SELECT thread, CASE WHEN len(list_filter(c, lambda x: x.price_minor < 0)) > 0 THEN 'negative' WHEN len(list_filter(c, lambda x: x.price_minor IS NULL)) > 0 THEN 'amount_missing'
  WHEN len(list_filter(c, lambda x: x.basis = 'coupon' AND x.cond = '')) > 0 THEN 'coupon_condition' WHEN len(list_distinct(bs)) < len(bs) THEN 'repeated_basis'
  WHEN len(list_distinct(list_transform(c, lambda x: x.currency))) > 1 THEN 'currencies_differ'
  WHEN len(c) > 1 AND (list_contains(bs, 'used_asking') OR list_contains(bs, 'completed_sale')) THEN 'used_not_alone' END AS problem,
  CASE WHEN list_contains(bs, 'sale') THEN 'sale' WHEN list_contains(bs, 'list') THEN 'list' WHEN list_contains(bs, 'used_asking') THEN 'used_asking'
    WHEN list_contains(bs, 'completed_sale') THEN 'completed_sale' ELSE 'coupon' END AS primary_basis FROM b""")
def price_components_pick(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    basis = F.element_at(F.array(*map(F.lit, ("sale", "list", "used_asking", "coupon", "completed_sale"))), (F.col("line") % 5 + 1).cast("int"))
    part = F.struct(
        "line", "source_id", "work_id", F.col("price_minor").alias("p"), "quantity", basis.alias("basis"), F.when(F.col("quantity") != 13, F.col("price_minor")).alias("price_minor"), "currency",
        F.when(F.col("quantity") % 2 == 0, "member").otherwise("").alias("condition"),
    )
    df = T.observations(spark, d).where(only).groupBy("thread").agg(F.array_sort(F.collect_list(part)).alias("c"))
    return df.select("thread", offers.components_problem(F.col("c")).alias("problem"), offers.primary_component(F.col("c"))["basis"].alias("primary_basis"))


@query(f"""{OBS} SELECT thread, count(DISTINCT (work_id, currency)) AS variants FROM observations GROUP BY thread HAVING count(DISTINCT (work_id, currency)) > 1""")
def shared_offer_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return upsert.conflicts(T.observations(spark, d), "thread", "work_id", "currency")


@query(f"""{OBS}, e AS (SELECT DISTINCT thread, sha256(concat_ws('|', thread, status)) AS digest FROM observations),
k AS (SELECT DISTINCT thread, sha256(concat_ws('|', thread, status)) AS digest FROM observations WHERE source_id % 4 <> 0)
SELECT thread, count(*) AS n FROM e ANTI JOIN k USING (thread, digest) GROUP BY thread""")
def pending_import_diff(spark: SparkSession, d: str) -> DataFrame:
    """Records whose digest the checkpoint doesn't have."""
    rec = T.observations(spark, d).withColumn("digest", F.sha2(F.concat_ws("|", F.col("thread").cast("string"), "status").cast("binary"), 256))
    expected, checkpoint = (x.select("thread", "digest").distinct() for x in (rec, rec.where("source_id % 4 <> 0")))
    return upsert.pending(expected, checkpoint, ["thread"], "digest").groupBy("thread").agg(F.count("*").alias("n"))


_ARRIVAL = "observed_at, line, source_id, work_id, price_minor, status, quantity"


def threads(spark: SparkSession, d: str) -> DataFrame:
    return T.observations(spark, d).join(T.sources(spark, d).select("source_id", "kind", F.col("source_format").alias("format")), "source_id")


@query(f"""{with_tables("observations", "sources")},
t AS (SELECT o.*, kind, source_format AS format, row_number() OVER w AS n, count(*) OVER (PARTITION BY thread) AS total,
  status = 'active' AS onn, status = 'completed' AND source_format = 'physical' AND kind IN ('marketplace', 'auction') AS sale, source_format = 'digital' AS off
  FROM observations o JOIN sources USING (source_id) WINDOW w AS (PARTITION BY thread ORDER BY {_ARRIVAL})),
a AS (SELECT thread, max(total) AS observations, min(n) FILTER (WHERE onn) AS f_on, max(n) FILTER (WHERE onn) AS l_on, max(n) FILTER (WHERE sale) AS l_sale, max(n) FILTER (WHERE off) AS l_off FROM t GROUP BY thread),
z AS (SELECT a.thread, max(t.n) AS l_after FROM a JOIN t ON t.thread = a.thread AND NOT t.onn AND t.n > f_on GROUP BY a.thread)
SELECT a.thread, observations, coalesce(l_on = observations, CASE WHEN l_on IS NULL THEN NULL ELSE FALSE END) AS is_active, x.observed_at AS active_at, y.price_minor AS asking_minor,
  CASE WHEN l_on <> observations THEN q.observed_at END AS inactive_at, CASE WHEN l_on <> observations THEN q.status END AS inactive_reason,
  s.observed_at AS sold_at, s.price_minor AS sold_minor, CASE WHEN l_sale IS NOT NULL THEN CASE WHEN l_off > l_sale THEN 'excluded' ELSE 'linked' END END AS sold_review
FROM a LEFT JOIN t x ON x.thread = a.thread AND x.n = f_on LEFT JOIN t y ON y.thread = a.thread AND y.n = l_on LEFT JOIN t s ON s.thread = a.thread AND s.n = l_sale
LEFT JOIN z ON z.thread = a.thread LEFT JOIN t q ON q.thread = a.thread AND q.n = l_after""")
def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    """Active and sold projections of every offer thread."""
    return lifecycle.fold(threads(spark, d), "thread", _ARRIVAL.split(", "))


@query(f"""{OBS}, t AS (SELECT thread, status, lag(status) OVER (PARTITION BY thread ORDER BY {_ARRIVAL}) AS previous FROM observations)
SELECT coalesce(previous, 'none') AS previous, status, count(*) AS n FROM t WHERE previous IS NULL OR previous <> status GROUP BY ALL""")
def lifecycle_transitions(spark: SparkSession, d: str) -> DataFrame:
    df = lifecycle.transitions(T.observations(spark, d), "thread", _ARRIVAL.split(", "))
    return df.groupBy(F.coalesce("previous", F.lit("none")).alias("previous"), "status").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS hit FROM events),
i AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
s AS (SELECT user_id, event_id, sum(1 - hit::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM i)
SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (WHERE streak = 5) AS stops FROM s GROUP BY user_id""")
def irrelevant_streak(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of events without a purchase, and how often five in a row would have stopped a search."""
    e = T.table(spark, d, "events").select("user_id", "event_id", "event_type")
    df = lifecycle.streaks(e, "user_id", ["event_id"], F.col("event_type") == "purchase")
    return df.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 5).alias("stops"))


@query(f"""{with_tables("jobs")} SELECT * FROM (
  SELECT source_id, job_id, priority, available_at, CAST(15 * pow(2, least(greatest(attempt - 1, 0), 6)) AS BIGINT) AS delay FROM jobs WHERE status = 'queued'
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY priority DESC, available_at, job_id) = 1)""")
def claimable_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The job each source would run next, and its delay if it failed."""
    df = upsert.keep_first(T.jobs(spark, d).where("status = 'queued'"), ["source_id"], [F.desc("priority"), "available_at", "job_id"])
    return df.select("source_id", "job_id", "priority", "available_at", offers.retry_delay(F.col("attempt")).alias("delay"))


@query(f"""{with_tables("works", "editions")}
SELECT publisher, count(*) AS n, min(publication_date) AS first_day, max(publication_date) AS last_day FROM editions JOIN works USING (work_id)
WHERE work_status = 'published' AND publication_date > DATE '2002-01-01' AND publication_date <= DATE '2003-01-01' GROUP BY publisher""")
def digest_window(spark: SparkSession, d: str) -> DataFrame:
    """New publications since the last digest's mark, up to now: open at the start, closed at the end."""
    e = T.editions(spark, d).where("publication_date > DATE '2002-01-01' AND publication_date <= DATE '2003-01-01'")
    df = e.join(T.works(spark, d).where("work_status = 'published'"), "work_id")
    return df.groupBy("publisher").agg(F.count("*").alias("n"), F.min("publication_date").alias("first_day"), F.max("publication_date").alias("last_day"))


@query("""SELECT event_id, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS day_start, date_trunc('day', ts + INTERVAL 9 HOUR) + INTERVAL 15 HOUR - INTERVAL 1 SECOND AS day_end
FROM events""")
def local_day_bounds(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """UTC bounds of the Tokyo day of an event."""
    e = T.table(spark, d, "events").where(only).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", *(F.to_timestamp_ntz(c.cast("string")).alias(n) for c, n in zip(offers.day_bounds(F.col("ts"), "Asia/Tokyo"), ("day_start", "day_end"), strict=True)))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
  CASE WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '\.example\.(com|net|org)$') THEN nullif(regexp_extract(url, '/(?:[a-z]{2})/([0-9]+)(?:[/.?#]|$)', 1), '') END AS external_id
FROM pages""")
def url_external_id(spark: SparkSession, d: str) -> DataFrame:
    p, url = T.table(spark, d, "pages"), F.col("url")
    return p.select("page_id", texts.host_of(url).alias("host"), texts.external_id(url, texts.ADAPTERS[:1]).alias("external_id"))


@query(r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, lower(url) LIKE 'http%' AND (host = 'example.org' OR host LIKE '%.example.org' OR host LIKE '%.example.net') AS allowed FROM h""")
def host_allow_list(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array(F.lit("example.org"), F.lit("example.net"))
    return T.table(spark, d, "pages").select("page_id", texts.host_allowed(F.col("url"), allowed).alias("allowed"))


@query(f"""WITH t AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents), s AS (SELECT t, regexp_matches(t, '{rules.STRONG_SIGNAL}') AS signal FROM t)
SELECT CASE {" ".join(f"WHEN regexp_matches(t, '{p}'){' AND NOT signal' if out else ''} THEN '{c}'" for c, p, out in rules.TITLE_RULES)} ELSE 'kept' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def title_exclusion_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every text as a title."""
    t = T.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("t"))
    return t.groupBy(F.coalesce(rules.title_exclusion(F.col("t")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def grants(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand in for grants."""
    k = F.col("s_suppkey")
    date = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    return T.table(spark, d, "supplier").select(
        k.alias("source_id"), F.when(k % 9 == 0, "pending").otherwise("approved").alias("status"), F.when(k % 13 == 0, "").otherwise("letter").alias("method"),
        F.when(k % 8 != 0, date(1993)).alias("reviewed_at"), date(1994).alias("effective_at"), F.when(k % 5 == 0, date(1997)).alias("expires_at"), F.lit("catalog").alias("purpose"),
        (k % 6).alias("rate"), F.when(k % 7 == 0, "session").otherwise("permanent").alias("retention"), F.lit("link").alias("display_mode"), F.lit("source").alias("attribution"),
        F.when(k % 4 == 0, F.array(F.lit("title"))).otherwise(F.array(F.lit("title"), F.lit("price"))).alias("allowed_fields"), F.array(F.lit("display"), F.lit("retain")).alias("allowed_uses"),
    )


@query(f"""{OBS}, j AS (SELECT observed_at AS t, source_id AS k FROM observations),
p AS (SELECT CASE WHEN k % 9 = 0 THEN 'status' WHEN k % 13 = 0 THEN 'method' WHEN k % 8 = 0 OR TIMESTAMP '1993-01-01' > t THEN 'not_reviewed' WHEN TIMESTAMP '1994-01-01' > t THEN 'not_effective'
  WHEN k % 5 = 0 AND TIMESTAMP '1997-01-01' <= t THEN 'expired' WHEN k % 6 <= 0 THEN 'rate' WHEN k % 7 = 0 THEN 'retention' WHEN k % 4 = 0 THEN 'fields' ELSE 'allowed' END AS verdict FROM j)
SELECT verdict, count(*) AS n FROM p GROUP BY verdict""")
def permission_allows(spark: SparkSession, d: str) -> DataFrame:
    """Whether each observation's source had granted price display and retention at the time."""
    df = T.observations(spark, d).select("source_id", "observed_at").join(grants(spark, d), "source_id")
    array = lambda *x: F.array(*map(F.lit, x))
    problem = permissions.grant_problem(F.col("observed_at"), array("title", "price"), array("display", "retain"))
    return df.groupBy(F.coalesce(problem, F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""{with_tables("works", "editions")},
e AS (SELECT edition_id AS entity, 'title' AS field, 'https://a.example/' || work_id AS url, 'bibliography' AS scope FROM editions WHERE edition_id % 3 <> 0),
p AS (SELECT edition_id AS entity, 'title' AS field, CASE WHEN edition_id % 7 = 0 THEN 'https://b.example/' ELSE 'https://a.example/' || work_id END AS url,
  CASE WHEN edition_id % 11 = 0 THEN 'prices' ELSE 'bibliography' END AS scope FROM editions WHERE edition_id % 5 <> 0)
SELECT * FROM (SELECT coalesce(e.entity, p.entity) AS entity, 'title' AS field, CASE WHEN p.scope IS NULL THEN 'missing' WHEN e.scope IS NULL THEN 'extra' WHEN e.url <> p.url THEN 'url' WHEN e.scope <> p.scope THEN 'scope' END AS gap
FROM e FULL JOIN p ON e.entity = p.entity) WHERE gap IS NOT NULL""")
def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = T.editions(spark, d).select(F.col("edition_id").alias("entity"), F.lit("title").alias("field"), F.concat(F.lit("https://a.example/"), F.col("work_id").cast("string")).alias("url"))
    k = F.col("entity")
    expected = e.where(k % 3 != 0).withColumn("scope", F.lit("bibliography"))
    provided = e.where(k % 5 != 0).withColumn("url", F.when(k % 7 == 0, "https://b.example/").otherwise(F.col("url"))).withColumn("scope", F.when(k % 11 == 0, "prices").otherwise("bibliography"))
    return permissions.evidence_gaps(expected, provided)


@query(f"""{with_tables("people")}, o AS (SELECT person_id, segment FROM people WHERE person_id % 4 <> 0), n AS (SELECT person_id, CASE WHEN person_id % 10 = 0 THEN 'OTHER' ELSE segment END AS segment FROM people WHERE person_id % 6 <> 0)
SELECT CASE WHEN o.person_id IS NULL THEN 'added' WHEN n.person_id IS NULL THEN 'retired' WHEN o.segment <> n.segment THEN 'changed' ELSE 'kept' END AS change, count(*) AS n
FROM o FULL JOIN n ON o.person_id = n.person_id GROUP BY 1""")
def queue_retire_restore(spark: SparkSession, d: str) -> DataFrame:
    """Current against previous queue snapshot."""
    p = T.people(spark, d).select("person_id", "segment")
    new = p.where("person_id % 6 <> 0").withColumn("segment", F.when(F.col("person_id") % 10 == 0, "OTHER").otherwise(F.col("segment")))
    return upsert.snapshots(p.where("person_id % 4 <> 0"), new, "person_id", F.col("segment")).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""{with_tables("listings")}, x AS (SELECT DISTINCT listing_id, CASE WHEN line % 2 = 0 THEN 'wrong_item' ELSE 'duplicate' END AS reason FROM listings WHERE quantity = 7)
SELECT CASE WHEN x.listing_id IS NULL THEN status ELSE 'excluded' END AS status, count(*) AS n, count(CASE WHEN x.listing_id IS NULL THEN edition_id END) AS linked FROM listings l LEFT JOIN x USING (listing_id) GROUP BY 1""")
def exclude_listings(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion marks and unlinks a listing, history stays."""
    l = T.listings(spark, d)
    x = l.where("quantity = 7").select("listing_id", F.lit(True).alias("gone")).distinct()
    df = l.join(x, "listing_id", "left").select(F.when(F.col("gone"), "excluded").otherwise(F.col("status")).alias("status"), F.when(F.col("gone").isNull(), F.col("edition_id")).alias("edition_id"))
    return df.groupBy("status").agg(F.count("*").alias("n"), F.count("edition_id").alias("linked"))


@query(f"""{with_tables("editions", "listings")}, m AS (SELECT edition_id AS old, edition_id + 2 AS new FROM editions WHERE edition_id % 40 = 4),
g AS (SELECT old, new FROM m JOIN editions a ON a.edition_id = old JOIN editions b ON b.edition_id = new WHERE a.format = b.format AND a.edition_publisher <> b.edition_publisher)
SELECT coalesce(g.new, edition_id) AS edition_id, count(*) AS n, count(g.old) AS moved FROM listings LEFT JOIN g ON g.old = edition_id WHERE edition_id IS NOT NULL GROUP BY 1""")
def supersede_editions(spark: SparkSession, d: str) -> DataFrame:
    """Listings follow a replaced edition to its successor, if the identity guard lets it pass."""
    e = T.editions(spark, d)
    a = e.where("edition_id % 40 = 4").select(F.col("edition_id").alias("old"), (F.col("edition_id") + 2).alias("new"), F.col("format").alias("f"), F.col("edition_publisher").alias("p"))
    g = a.join(e, F.col("new") == F.col("edition_id")).where("format = f AND edition_publisher <> p").select("old", "new")
    df = T.listings(spark, d).where("edition_id IS NOT NULL").join(g, F.col("edition_id") == F.col("old"), "left")
    return df.groupBy(F.coalesce("new", "edition_id").alias("edition_id")).agg(F.count("*").alias("n"), F.count("old").alias("moved"))


@query(f"""{with_tables("credits")}, a AS (SELECT work_id, string_agg(DISTINCT person_id, ',' ORDER BY person_id) AS list FROM credits GROUP BY work_id),
w AS (SELECT work_id, unnest(list_distinct(list_transform(string_split(list, ','), lambda x: trim(x)))) AS person FROM a)
SELECT work_id, count(*) AS people, count(DISTINCT person) AS distinct_people, min(CAST(person AS BIGINT)) AS first_person FROM w GROUP BY work_id""")
def credit_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Credits recomputed from the works' comma-separated name lists."""
    lists = T.credits(spark, d).groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("person_id")), lambda x: x.cast("string")), ", ").alias("list"))
    w = lists.select("work_id", F.explode(F.array_distinct(texts.split_list(F.col("list")))).alias("person"))
    return w.groupBy("work_id").agg(F.count("*").alias("people"), F.countDistinct("person").alias("distinct_people"), F.min(F.col("person").cast("long")).alias("first_person"))


@query(f"""{with_tables("people", "credits")}, one AS (SELECT alias, min(person_id) AS canonical FROM people GROUP BY alias),
n AS (SELECT work_id, person_id, alias, row_number() OVER (PARTITION BY work_id ORDER BY person_id) AS pos FROM (SELECT DISTINCT work_id, person_id FROM credits) JOIN people USING (person_id)),
r AS (SELECT n.work_id, n.pos, CASE WHEN c.person_id IS NULL THEN n.person_id ELSE canonical END AS resolved FROM n JOIN one USING (alias) LEFT JOIN (SELECT DISTINCT work_id, person_id FROM n) c ON c.work_id = n.work_id AND c.person_id = canonical)
SELECT work_id, resolved, min(pos) AS pos FROM r GROUP BY work_id, resolved""")
def credit_resolution(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """An alias gives way to its canonical person only where that person is listed on the same work; first position wins."""
    p = T.people(spark, d)
    canonical = p.groupBy("alias").agg(F.min("person_id").alias("canonical"))
    n = T.credits(spark, d).where(only).select("work_id", "person_id").distinct().join(p.select("person_id", "alias"), "person_id")
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("work_id").orderBy("person_id")))
    listed = n.select(F.col("work_id").alias("w"), F.col("person_id").alias("c")).distinct()
    r = n.join(canonical, "alias").join(listed, (F.col("work_id") == F.col("w")) & (F.col("canonical") == F.col("c")), "left")
    return r.groupBy("work_id", F.when(F.col("c").isNull(), F.col("person_id")).otherwise(F.col("canonical")).alias("resolved")).agg(F.min("pos").alias("pos"))


@query(f"""{with_tables("observations", "works")}, k AS (SELECT w.work_id, lower(title) AS key, publisher, source_id FROM works w JOIN observations USING (work_id))
SELECT key, publisher, min(work_id) AS canonical, count(DISTINCT work_id) AS works, count(DISTINCT source_id) AS sources FROM k GROUP BY key, publisher HAVING count(DISTINCT work_id) >= 2 AND count(DISTINCT source_id) >= 2""")
def work_groups_cross_source(spark: SparkSession, d: str) -> DataFrame:
    """Works of one title key and publisher that at least two sources offer as at least two works."""
    w = T.works(spark, d).select("work_id", F.lower("title").alias("key"), "publisher")
    df = w.join(T.observations(spark, d).select("work_id", "source_id"), "work_id").groupBy("key", "publisher").agg(F.min("work_id").alias("canonical"), F.countDistinct("work_id").alias("works"), F.countDistinct("source_id").alias("sources"))
    return df.where("works >= 2 AND sources >= 2")


@query("""WITH r AS (SELECT p_name || p_brand AS id, p_size AS score, p_type AS cast_name, nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, '') AS cover, p_partkey FROM part)
SELECT id, arg_max(p_partkey, (score, p_partkey)) AS best, string_agg(DISTINCT cast_name, ',' ORDER BY cast_name) AS casts, arg_min(cover, p_partkey) FILTER (WHERE cover IS NOT NULL) AS cover FROM r GROUP BY id""")
def release_merge(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate releases: the best scored stays, casts are united, the first known cover fills blanks."""
    cover = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    return T.table(spark, d, "part").groupBy(F.concat("p_name", "p_brand").alias("id")).agg(
        F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("best"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("casts"),
        F.min_by(cover, F.when(cover.isNotNull(), F.col("p_partkey"))).alias("cover"),
    )


@query(r"""WITH i AS (SELECT page_id, page_id // 10 AS item, regexp_replace(lower(url), '[?#].*$', '') AS key, length(url) AS quality FROM pages)
SELECT item, count(*) AS images, string_agg(page_id, ',' ORDER BY pos) AS ids FROM (
  SELECT item, key, arg_max(page_id, (quality, -page_id)) AS page_id, min(page_id) AS pos FROM i GROUP BY item, key) GROUP BY item""")
def image_gallery_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One image of each address (its query aside), the better one, at its first position."""
    i = T.table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("item"), F.regexp_replace(F.lower("url"), r"[?#].*$", "").alias("key"), F.length("url").alias("quality"))
    best = i.groupBy("item", "key").agg(F.max_by("page_id", F.struct("quality", -F.col("page_id"))).alias("page_id"), F.min("page_id").alias("pos"))
    nest = F.array_sort(F.collect_list(F.struct("pos", "page_id")))
    return best.groupBy("item").agg(F.count("*").alias("images"), F.array_join(F.transform(nest, lambda x: x["page_id"].cast("string")), ",").alias("ids"))


@query(f"""{with_tables("editions")}, e AS (SELECT *, CASE WHEN isbn <> '' THEN isbn ELSE 'p' || edition_publisher END AS key FROM editions WHERE format = 'digital')
SELECT key, min(edition_id) AS kept, count(*) AS merged, count(DISTINCT edition_publisher) > 1 AS conflict FROM e GROUP BY key""")
def edition_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Digital editions of one ISBN (or publisher, without one) collapse to the first; publishers that differ are a conflict."""
    key = F.when(F.col("isbn") != "", F.col("isbn")).otherwise(F.concat(F.lit("p"), "edition_publisher"))
    return T.editions(spark, d).where("format = 'digital'").groupBy(key.alias("key")).agg(F.min("edition_id").alias("kept"), F.count("*").alias("merged"), (F.countDistinct("edition_publisher") > 1).alias("conflict"))
