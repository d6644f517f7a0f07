"""The observation feed as a stream: idempotent intake, lifecycle state, digests and block cool-down."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bindery.functions.offers import RESALE_KINDS
from bindery.operators.upsert import keep_first

LIFECYCLE = "key string, observations long, is_active boolean, asking_minor long, sold_minor long, sold_review string"


def unique_observations(stream: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """Each observation once; a replay within `delay` is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


class Lifecycle(StatefulProcessor):
    """State of one listing, in order of arrival; the batch twin is operators.lifecycle.fold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listing", "n long, active boolean, asking long, sold long, review string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, active, asking, sold, review = self.state.get() or (0, None, None, None, None)
        for pdf in rows:
            pdf = pdf.sort_values("arrival", kind="stable")
            for status, fmt, kind, price in zip(pdf["status"], pdf["format"], pdf["kind"], pdf["price_minor"], strict=True):
                n += 1
                amount = None if pd.isna(price) else int(price)
                if status == "active" and fmt in ("physical", "digital") and not pd.isna(kind):
                    active, asking = True, amount
                elif active is not None:
                    active = False
                if status == "completed" and fmt == "physical" and kind in RESALE_KINDS:
                    sold, review = amount, "linked"
                elif review is not None and (status == "excluded" or fmt == "digital"):
                    review = "excluded"
        self.state.update((n, active, asking, sold, review))
        row = {"key": key[0], "observations": n, "is_active": active, "asking_minor": asking, "sold_minor": sold, "sold_review": review}
        yield pd.DataFrame([row]).astype({"asking_minor": "Int64", "sold_minor": "Int64", "is_active": "boolean"})

    def close(self) -> None:
        pass


def lifecycle_stream(stream: DataFrame, key: str) -> DataFrame:
    """The lifecycle of each key after each micro-batch; needs columns arrival, status, format, kind and price_minor."""
    return stream.groupBy(F.col(key).cast("string").alias("key")).transformWithStateInPandas(Lifecycle(), outputStructType=LIFECYCLE, outputMode="Update", timeMode="None")


def latest_sink(spark: SparkSession, path: str, keys: list[str], order: list[str]):
    """foreachBatch sink that keeps the last row of each key. Each batch writes the state after it beside the one before, under
    its own number, so that a batch that is run again starts from the same state and gives the same one. Older states go: only
    the last batch can be run again. For a state much larger than its batches, run.updated writes the changes alone."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = batch
        if batch_id and (old := previous(spark, path, batch_id)) is not None:
            state = old.unionByName(batch)
        keep_first(state, keys, [F.desc(c) for c in order]).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        sc = spark.sparkContext
        for old in range(max(0, batch_id - 3), batch_id - 1):
            where = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    return fold


def previous(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State after the last batch before `batch_id`: the states' numbers are partitions of one table."""
    from pyspark.errors import AnalysisException

    try:
        states = spark.read.parquet(path).where(F.col("v") < batch_id)
    except AnalysisException:  # no batch has written yet
        return None
    last = states.agg(F.max("v").alias("v")).first()["v"]
    return None if last is None else spark.read.parquet(f"{path}/v={last}")


def digest(works: DataFrame, published: str, mark, now, gap_hours: int = 20) -> DataFrame:
    """New publications in (mark, now]; none on the first run (mark is None) or before the gap has passed."""
    if mark is None or (now - mark).total_seconds() < gap_hours * 3600:
        return works.limit(0)
    return works.where((F.col(published) > F.lit(mark)) & (F.col(published) <= F.lit(now)))


def repeated_pages(pages: DataFrame, run: str, order: str, urls: str) -> DataFrame:
    """Pages whose list of addresses an earlier page of the run had: where a crawl should stop."""
    from pyspark.sql import Window

    df = pages.withColumn("fingerprint", F.sha2(F.to_json(urls).cast("binary"), 256))
    first = F.min(order).over(Window.partitionBy(run, "fingerprint"))
    return df.withColumn("first_page", first).where(F.col(order) > F.col("first_page"))


def blocked_sources(blocks: DataFrame, now, hours: int = 24) -> DataFrame:
    """Sources whose last block is younger than the cool-down."""
    last = blocks.groupBy("source_id").agg(F.max("blocked_at").alias("blocked_at"))
    return last.where(F.col("blocked_at") > F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))


def uncovered(candidates: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Candidates whose detail page is still to be read."""
    return candidates.join(details.select(key), key, "left_anti")
