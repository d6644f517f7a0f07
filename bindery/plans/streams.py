"""The feed as streams, each beside its batch twin: both must agree with one SQL. The events stand in for pages, visits and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.plans import fixtures as T
from bindery.plans.fixtures import registry
from bindery.storage import Scratch
from bindery.streaming import clocks, cooldown, crawl, intake, run

QUERIES, ORACLE = {}, {}
query = registry(QUERIES, ORACLE)
#: Landings of a stream's input.
LANDINGS = 3


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the number in their properties, and the landing that brings them: by time, so that arrivals keep their order."""
    df = T.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return df.withColumn("landing", (F.col("event_id") % 300 / 100).cast("int"))


def _thirds(df: DataFrame, order: str) -> DataFrame:
    """`df` with the third that a row's `order` falls into: one aggregate for the limits, none of the rows on the driver."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    third = F.floor((F.col(order) - F.lit(low or 0)) * LANDINGS / F.lit((high or 0) - (low or 0) + 1))
    return df.withColumn("landing", third.cast("int"))


def _landed(spark: SparkSession, df: DataFrame, scratch: Scratch) -> DataFrame:
    stored, path = scratch.put(df, "arrivals"), scratch.folder("landings")
    return run.landed(spark, path, df.schema, run.spread(stored, path, F.col("landing"), LANDINGS)).drop("landing")


def _drained(spark: SparkSession, df: DataFrame, stream, runs=run.drained) -> DataFrame:
    scratch = Scratch(spark)
    out, checkpoint, source = scratch.folder("out"), scratch.folder("checkpoint"), _landed(spark, df, scratch)
    wanted = stream(source)
    runs(wanted, out, checkpoint)
    return spark.read.schema(wanted.schema).parquet(out)


# --- cool-down of blocked sources ------------------------------------------------------------------------------------

_HELD = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source_id, ts, event_id, event_type = 'error' AS block FROM events),
u AS (SELECT *, max(CASE WHEN block THEN ts + INTERVAL 24 HOUR END) OVER (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS until FROM e),
v AS (SELECT source_id, CASE WHEN block THEN 'blocked' WHEN ts < until THEN 'held' ELSE 'open' END AS event, until FROM u)
SELECT source_id, event, count(*) AS n, max(CASE WHEN event <> 'open' THEN until END) AS retry_after FROM v GROUP BY source_id, event"""


def _visits(spark: SparkSession, d: str) -> DataFrame:
    """Errors block their user's source; all else are visits."""
    e = _thirds(_events(spark, d).withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp"))), "seconds")
    return e.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.col("props")).alias("reason"), "landing")


def _visit_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id", "event").agg(F.count("*").alias("n"), F.max("retry_after").cast("timestamp_ntz").alias("retry_after"))


@query(_HELD)
def visits_held(spark: SparkSession, d: str) -> DataFrame:
    """Visits to sources that were blocked within a day before."""
    return _visit_counts(cooldown.cooled(_visits(spark, d).drop("landing")))


@query(_HELD)
def visits_held_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream with a timer for each blocked source; none fires within the run."""
    return _visit_counts(_drained(spark, _visits(spark, d), cooldown.cooled_stream, run.settled).where("event <> 'released'"))


# --- limits of intake ------------------------------------------------------------------------------------------------

_LIMITS = """WITH e AS (SELECT user_id % 7 AS job_id, event_id, event_type IN ('purchase', 'click') AS detail, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS r FROM events),
p AS (SELECT job_id, CAST(r // 60 + 1 AS INT) AS page, CAST(r % 60 + 1 AS INT) AS place, '/' || job_id || '/' || event_id AS url, detail FROM e),
q AS (SELECT *, CASE WHEN page > 20 THEN 'pages' WHEN place > 50 THEN 'candidates' END AS early FROM p),
c AS (SELECT *, count(*) FILTER (WHERE early IS NULL) OVER w AS n, count(*) FILTER (WHERE early IS NULL AND detail) OVER w AS k FROM q WINDOW w AS (PARTITION BY job_id ORDER BY page, place ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, coalesce(early, CASE WHEN n > 450 THEN 'items' WHEN detail AND k > 80 THEN 'details' ELSE 'taken' END) AS verdict FROM c),
m AS (SELECT job_id, count(*) FILTER (WHERE verdict = 'taken') AS taken, min(struct_pack(page := page, place := place, url := url)) FILTER (WHERE verdict <> 'taken') AS c FROM v GROUP BY job_id)
SELECT CAST(job_id AS VARCHAR) AS job_id, taken, c.page AS page, c.place AS place, c.url AS url FROM m"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Sixty items a page; purchases and clicks need their detail page."""
    job = F.col("user_id") % 7
    r = F.row_number().over(Window.partitionBy(job).orderBy("event_id")) - 1
    e = _events(spark, d).withColumns({"job_id": job, "r": r})
    page = F.floor(F.col("r") / 60).cast("int") + 1
    df = e.select("job_id", page.alias("page"), (F.col("r") % 60 + 1).cast("int").alias("place"), F.concat_ws("/", F.lit(""), job.cast("string"), F.col("event_id").cast("string")).alias("url"), F.col("event_type").isin("purchase", "click").alias("detail"))
    return df.withColumn("landing", F.least(F.floor((F.col("page") - 1) / 4), F.lit(LANDINGS - 1)).cast("int"))


@query(_LIMITS)
def job_cursors(spark: SparkSession, d: str) -> DataFrame:
    """What each job takes within the limits of intake, and where its next run begins."""
    return intake.cursors(intake.limited(_items(spark, d).drop("landing"), candidates=50))


@query(_LIMITS)
def job_cursors_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from landed pages, one landing at a time, with the counts kept in state."""
    return intake.cursors(_drained(spark, _items(spark, d), lambda s: intake.limited_stream(s, candidates=50)))


@query("SELECT CAST((event_id % 300) // 100 AS BIGINT) AS batch, count(*) AS received, count(*) FILTER (WHERE value >= 20) AS accepted, count(*) FILTER (WHERE value < 20 OR value IS NULL) AS rejected FROM events GROUP BY 1")
def intake_metrics_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each micro-batch, observed while it goes by: no second pass. What reaches the driver is a row for each landing."""
    scratch = Scratch(spark)
    stream = intake.metered(_landed(spark, _events(spark, d), scratch), "intake", F.coalesce(F.col("value") >= 20, F.lit(False)))
    done = run.drained(stream, scratch.folder("out"), scratch.folder("checkpoint"))
    rows = [(p["batchId"], *(p["observedMetrics"]["intake"][c] for c in ("received", "accepted", "rejected"))) for p in done.recentProgress if p["numInputRows"]]
    return spark.createDataFrame(rows, "batch long, received long, accepted long, rejected long")


# --- where crawls stop -----------------------------------------------------------------------------------------------

_CRAWL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS page, event_type || ' ' || json_extract_string(props, '$.k') AS fp,
  CAST(event_type IN ('purchase', 'click') AS INT) AS matches, value >= 2 AS more FROM events),
i AS (SELECT *, count(*) FILTER (WHERE matches > 0) OVER (PARTITION BY run ORDER BY page ROWS UNBOUNDED PRECEDING) AS island, min(page) OVER (PARTITION BY run, fp) AS found FROM e),
s AS (SELECT *, CAST(count(*) FILTER (WHERE matches = 0) OVER (PARTITION BY run, island ORDER BY page ROWS UNBOUNDED PRECEDING) AS INT) AS streak FROM i),
t AS (SELECT run, page, streak, CASE WHEN found < page THEN found END AS first_page,
  CASE WHEN NOT more THEN 'public_search_exhausted' WHEN streak >= 5 THEN 'query_relevance_exhausted' WHEN found < page THEN 'pagination_stalled' ELSE 'running' END AS status FROM s)
SELECT * FROM t WHERE page <= coalesce((SELECT min(page) FROM t AS u WHERE u.run = t.run AND u.status <> 'running'), page)"""


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are the pages of a run; the landings shuffle them."""
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = _events(spark, d).withColumn("page", page)
    return e.select(
        F.col("user_id").cast("string").alias("run"), "page", F.array("event_type", F.col("k").cast("string")).alias("urls"), F.col("event_type").isin("purchase", "click").cast("long").alias("matches"),
        (F.col("value") >= 2).alias("more"), F.pmod(F.hash("event_id"), F.lit(LANDINGS)).alias("landing"),
    )


@query(_CRAWL)
def crawl_stops(spark: SparkSession, d: str) -> DataFrame:
    return crawl.crawled(_crawled(spark, d).drop("landing"))


@query(_CRAWL)
def crawl_stops_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from pages that land in any order and wait in state for those before them."""
    return _drained(spark, _crawled(spark, d), crawl.crawled_stream)


# --- arrival and evidence time ---------------------------------------------------------------------------------------

_CLOCKS = """WITH e AS (SELECT user_id AS key, event_id AS arrival, ts - to_hours(CAST(json_extract(props, '$.k') AS INT)) AS observed_at, CASE event_type WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'completed' ELSE 'ended' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'digital' ELSE 'physical' END AS format, CAST(round(value * 100) AS BIGINT) AS price_minor FROM events),
s AS (SELECT key, arg_max(struct_pack(p := price_minor, o := observed_at), (observed_at, arrival)) AS s FROM e WHERE status = 'completed' AND format = 'physical' GROUP BY key),
m AS (SELECT key, count(*) AS observations, arg_max(struct_pack(st := status, p := price_minor, o := observed_at), arrival) AS a, arg_max(struct_pack(st := status, p := price_minor, o := observed_at), (observed_at, arrival)) AS b FROM e GROUP BY key),
u AS (SELECT 'arrival' AS mode, key, observations, a AS x FROM m UNION ALL SELECT 'event_time', key, observations, b FROM m)
SELECT mode, key, observations, x.st AS status, x.p AS price_minor, x.o AS observed_at, s.p AS sold_minor, s.o AS sold_at FROM u LEFT JOIN s USING (key)"""


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """Observed up to some days before they arrive; the landings shuffle them."""
    e = _events(spark, d)
    status = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "purchase", "completed").otherwise("ended")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), (F.col("ts").cast("timestamp_ntz") - F.make_interval(hours="k")).alias("observed_at"), status.alias("status"),
        F.when(F.col("event_id") % 5 == 0, "digital").otherwise("physical").alias("format"), F.round(F.col("value") * 100).cast("long").alias("price_minor"), F.pmod(F.hash("event_id"), F.lit(LANDINGS)).alias("landing"),
    )


@query(_CLOCKS)
def two_clock_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = _offers(spark, d).drop("landing")
    a, b = (clocks.two_clocks(rows, m).select(F.lit(m).alias("mode"), "*") for m in clocks.MODES)
    return a.unionByName(b)


@query(_CLOCKS)
def two_clock_listings_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a streaming aggregate over shuffled landings, one stream for each mode over the same files."""
    scratch = Scratch(spark)
    source, parts = _landed(spark, _offers(spark, d), scratch), []
    for m in clocks.MODES:
        updates = run.updated(clocks.two_clocks(source, m), scratch.folder("out"), scratch.folder("checkpoint"))
        parts.append(clocks.latest_versions(updates).select(F.lit(m).alias("mode"), "*"))
    return parts[0].unionByName(parts[1])
