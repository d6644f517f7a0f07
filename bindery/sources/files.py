"""Files in and out: JSON captures, RSS items, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = (
    "observationId string, externalId string, editionId string, url string, title string, condition string, status string, priceMinor long, currency string, priceType string, "
    "priceBasis string, priceComponents array<struct<basis:string,priceMinor:long,currency:string,condition:string>>, format string, isbn string, observedAt timestamp"
)
BATCH = f"jobId string, sourceId string, pageNumber int, hasMore boolean, items array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in OBSERVATION.split(', '))}>>"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Observation batches, one JSON document a file, as one row for each item with its place of arrival."""
    df = spark.read.schema(BATCH).json(path, multiLine=True)
    return df.select("jobId", "sourceId", "pageNumber", F.col("_metadata.file_path").alias("file"), F.posexplode("items").alias("position", "item")).select(
        "jobId", "sourceId", "pageNumber", "file", "position", "item.*"
    )


def read_captures(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON files of many folders, with the folder's name as key."""
    return spark.read.schema(schema).json(pattern, multiLine=True).withColumn("capture", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items; element names come without their namespaces."""
    strip = F.regexp_replace("value", r"<(/?)[A-Za-z]+:", "<$1")
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(strip, F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))).alias("x"))
    schema = "title string, link string, category array<string>, pubDate string, date string, issued string, identifier array<string>"
    return text.select(F.from_xml("x", schema).alias("i")).select("i.*")


#: Rows of a report that is written as one file.
REPORT_ROWS = 1_000_000


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; nested cells are JSON, and the first column's name carries the mark that spreadsheets
    look for. A report is for readers: more than REPORT_ROWS rows are an error."""
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows: write the table as Parquet")
    nested = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    flat = df.select(*nested)
    flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0]).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def markdown_lines(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, markdown): one section for each group, rows in the order of `columns`. Built by the executors."""
    row = F.concat(F.lit("- "), F.concat_ws(" — ", *(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")) for c in columns)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*columns, row.alias("line")))), lambda x: x["line"])
    return df.groupBy(group).agg(F.concat(F.lit("## "), F.first(F.col(group).cast("string")), F.lit("\n\n"), F.array_join(lines, "\n")).alias("markdown"))
