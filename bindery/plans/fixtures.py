"""Catalog tables made from the driver's star schema, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import offers


def registry(queries: dict, oracle: dict):
    """Decorator that names a query after its function, with the SQL that it must agree with."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    kind = F.when(k == 0, "marketplace").when(k == 1, "auction").when(k == 2, "bookstore").otherwise("digital_store")
    nation = F.broadcast(table(spark, d, "nation"))
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), F.col("n_name").alias("region"), kind.alias("kind"),
        offers.source_format(kind).alias("source_format"), (F.col("s_suppkey") % 7 != 0).alias("enabled"), (F.col("s_suppkey") % 3 == 0).alias("authorized"),
    )


def works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"),
        F.when(F.col("p_size") <= 45, "published").otherwise("superseded").alias("work_status"),
        F.when(F.col("p_type") == "ECONOMY", "magazine_issue").otherwise("photobook").alias("publication_type"),
        (F.col("p_partkey") % 5).cast("int").alias("origin_key"), F.col("p_size").alias("size"),
        F.when(F.col("p_type") == "ECONOMY", F.format_string("20%02d-%02d", (F.col("p_partkey") % 24).cast("int"), (F.col("p_partkey") % 14).cast("int"))).otherwise("").alias("issue_month"),
    )


def editions(spark: SparkSession, d: str) -> DataFrame:
    """Two editions of each work; publication dates are days after 2000-01-01 by edition id."""
    fmt = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("physical").alias("f")), F.struct(F.lit(1).alias("k"), F.lit("digital").alias("f"))))
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", fmt.alias("x"))
    eid = F.col("p_partkey") * 2 + F.col("x.k")
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    return df.select(
        eid.alias("edition_id"), F.col("p_partkey").alias("work_id"), F.col("x.f").alias("format"), F.col("p_brand").alias("edition_publisher"),
        F.when(F.col("p_size") == 1, "superseded").otherwise("published").alias("edition_status"),
        F.when(eid % 3 != 0, day(eid % 7000)).alias("publication_date"), F.when(eid % 4 == 1, day(eid % 8000)).alias("store_date"),
        F.when(eid % 6 == 0, day(eid % 6000)).alias("release_date"),
        F.when(eid % 5 != 0, F.concat(F.lit("978"), F.lpad((eid % 1000).cast("string"), 10, "0"))).otherwise("").alias("isbn"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.concat_ws(":", s.cast("string"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("listing_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("external_id"),
        s.alias("source_id"), F.col("l_partkey").alias("work_id"), F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("observed_at"),
        F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "R", "ended").otherwise("completed").alias("status"),
        F.round(F.col("l_extendedprice").cast("decimal(18,4)") * 100, 0).cast("long").alias("price_minor"),
        F.when(s % 3 == 0, "JPY").when(s % 3 == 1, "TWD").otherwise("USD").alias("currency"), F.col("l_quantity").cast("int").alias("quantity"),
    )


NEWEST = ("observed_at", "work_id", "price_minor", "status", "quantity")


def newest() -> list:
    """Latest first, and a total order, as no column set of the observations is unique."""
    return [F.desc(c) for c in NEWEST]


def newest_of(df: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key: an aggregate with partial results, so a key with many rows is no task's burden."""
    rest = [c for c in df.columns if c not in keys and c not in NEWEST]
    best = df.groupBy(*keys).agg(F.max(F.struct(*NEWEST, *rest)).alias("_best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))


def latest(df: DataFrame, *keys: str, order=None) -> DataFrame:
    """The first row of each key in `order`."""
    w = Window.partitionBy(*keys).orderBy(*(newest() if order is None else order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def listings(spark: SparkSession, d: str) -> DataFrame:
    df = newest_of(observations(spark, d), "listing_id").join(sources(spark, d), "source_id")
    return df.withColumn("format", F.col("source_format")).withColumn(
        "edition_id", F.when(F.col("work_id") % 11 != 0, F.col("work_id") * 2 + (F.col("format") == "digital").cast("int"))
    )


def credits(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (work_id, person_id, role)."""
    o = table(spark, d, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    role = F.when(p.isin("1", "2"), "featured").when(p == "3", "cover_model")
    df = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("work_id"), F.col("o_custkey").alias("person_id"), role.alias("role"))
    return df.where("role IS NOT NULL").distinct()


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_key"),
        F.concat_ws("-", F.lower("c_mktsegment"), (F.col("c_custkey") % 97).cast("string")).alias("alias"),
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 37).alias("source_id"),
        F.when(s == "F", "succeeded").when(s == "O", "queued").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("available_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_orderkey") % 9).cast("int").alias("attempt"),
    )


#: The same tables in SQL.
CTE = {
    "sources": """sources AS (
  SELECT s_suppkey AS source_id, s_name AS source_name, n_name AS region,
    CASE s_suppkey % 4 WHEN 0 THEN 'marketplace' WHEN 1 THEN 'auction' WHEN 2 THEN 'bookstore' ELSE 'digital_store' END AS kind,
    CASE WHEN s_suppkey % 4 = 3 THEN 'digital' ELSE 'physical' END AS source_format, s_suppkey % 7 <> 0 AS enabled, s_suppkey % 3 = 0 AS authorized
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "works": """works AS (
  SELECT p_partkey AS work_id, p_name AS title, p_brand AS publisher, CASE WHEN p_size <= 45 THEN 'published' ELSE 'superseded' END AS work_status,
    CASE WHEN p_type = 'ECONOMY' THEN 'magazine_issue' ELSE 'photobook' END AS publication_type, CAST(p_partkey % 5 AS INT) AS origin_key, p_size AS size,
    CASE WHEN p_type = 'ECONOMY' THEN format('20{:02d}-{:02d}', p_partkey % 24, p_partkey % 14) ELSE '' END AS issue_month
  FROM part)""",
    "editions": """editions AS (
  SELECT e AS edition_id, p_partkey AS work_id, CASE WHEN k = 0 THEN 'physical' ELSE 'digital' END AS format, p_brand AS edition_publisher,
    CASE WHEN p_size = 1 THEN 'superseded' ELSE 'published' END AS edition_status,
    CASE WHEN e % 3 <> 0 THEN DATE '2000-01-01' + CAST(e % 7000 AS INT) END AS publication_date,
    CASE WHEN e % 4 = 1 THEN DATE '2000-01-01' + CAST(e % 8000 AS INT) END AS store_date,
    CASE WHEN e % 6 = 0 THEN DATE '2000-01-01' + CAST(e % 6000 AS INT) END AS release_date,
    CASE WHEN e % 5 <> 0 THEN '978' || lpad(CAST(e % 1000 AS VARCHAR), 10, '0') ELSE '' END AS isbn
  FROM (SELECT *, p_partkey * 2 + k AS e FROM part, (VALUES (0), (1)) AS t(k)))""",
    "observations": """observations AS (
  SELECT concat_ws(':', l_suppkey, concat_ws('-', l_orderkey, l_linenumber)) AS listing_id, concat_ws('-', l_orderkey, l_linenumber) AS external_id,
    l_suppkey AS source_id, l_partkey AS work_id, l_orderkey AS thread, l_linenumber AS line, l_shipdate AS observed_at,
    CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'ended' ELSE 'completed' END AS status,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * 100, 0) AS BIGINT) AS price_minor,
    CASE l_suppkey % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'TWD' ELSE 'USD' END AS currency, CAST(l_quantity AS INT) AS quantity
  FROM lineitem)""",
    "listings": """listings AS (
  SELECT o.*, source_name, region, kind, source_format, enabled, authorized, source_format AS format,
    CASE WHEN work_id % 11 <> 0 THEN work_id * 2 + CAST(source_format = 'digital' AS INT) END AS edition_id
  FROM (SELECT * FROM observations QUALIFY row_number() OVER (
    PARTITION BY listing_id ORDER BY observed_at DESC, work_id DESC, price_minor DESC, status DESC, quantity DESC) = 1) o JOIN sources USING (source_id))""",
    "credits": """credits AS (
  SELECT DISTINCT l_partkey AS work_id, o_custkey AS person_id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'featured' ELSE 'cover_model' END AS role
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority[1] IN ('1', '2', '3'))""",
    "people": """people AS (
  SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation_key, lower(c_mktsegment) || '-' || (c_custkey % 97) AS alias FROM customer)""",
    "jobs": """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey % 37 AS source_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
    o_orderdate AS available_at, CAST(o_orderpriority[1] AS INT) AS priority, CAST(o_orderkey % 9 AS INT) AS attempt FROM orders)""",
}
_NEEDS = {"listings": ("sources", "observations")}


def with_tables(*names: str) -> str:
    """WITH clause of the named tables and those they are made of."""
    order: list[str] = []
    for n in names:
        for k in (*_NEEDS.get(n, ()), n):
            if k not in order:
                order.append(k)
    return "WITH " + ",\n".join(CTE[n] for n in order)
