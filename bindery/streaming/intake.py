"""Landed batches as a stream with the limits of intake, and the counts of what was received, accepted and rejected.

A file holds one batch of items of a job. A batch beyond BATCH items is rejected whole. Of a job's items, a page gives CANDIDATES
at most and pages beyond PAGES none; of the rest, DETAILS items may have their detail page read and ITEMS are taken in all. The first item left is
the job's cursor: page, place and address from which the next run goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

#: Items of a batch, pages of a job, candidates of a page, detail pages and items of a job.
BATCH, PAGES, CANDIDATES, DETAILS, ITEMS = 500, 20, 400, 80, 450
TAKEN = "job_id string, page int, place int, url string, verdict string, n long"


class Limits(StatefulProcessor):
    """Counts of one job: items taken and detail pages asked for."""

    def __init__(self, details: int, items: int):
        self.details, self.items = details, items

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "taken long, details long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        taken, details = self.counts.get() if self.counts.exists() else (0, 0)
        for pdf in rows:
            pdf = pdf.sort_values(["page", "place"], kind="stable")
            # Those refused before they are counted keep their verdict; the others are numbered.
            free = pdf["verdict"].isna().to_numpy()
            asks = free & pdf["detail"].to_numpy(bool)
            n, d = taken + np.cumsum(free), details + np.cumsum(asks)
            verdict = np.where(~free, pdf["verdict"], np.where(n > self.items, "items", np.where(asks & (d > self.details), "details", "taken")))
            taken, details = taken + int(free.sum()), details + int(asks.sum())
            yield pd.DataFrame({"job_id": key[0], "page": pdf["page"].astype("int32"), "place": pdf["place"].astype("int32"), "url": pdf["url"], "verdict": verdict, "n": np.where(free, n, 0)})
        self.counts.update((taken, details))

    def close(self) -> None:
        pass


def _early(df: DataFrame, pages: int, candidates: int) -> DataFrame:
    """What a page's number and an item's place on it decide."""
    early = F.when(F.col("page") > pages, "pages").when(F.col("place") > candidates, "candidates")
    return df.select(F.col("job_id").cast("string").alias("job_id"), "page", "place", "url", "detail", early.alias("verdict"))


def limited_stream(stream: DataFrame, pages: int = PAGES, candidates: int = CANDIDATES, details: int = DETAILS, items: int = ITEMS) -> DataFrame:
    """Verdicts on a stream of (job_id, page, place, url, detail), whose landings follow the order of a job's pages."""
    df = _early(stream, pages, candidates)
    return df.groupBy("job_id").transformWithStateInPandas(Limits(details, items), outputStructType=TAKEN, outputMode="Append", timeMode="None")


def limited(df: DataFrame, pages: int = PAGES, candidates: int = CANDIDATES, details: int = DETAILS, items: int = ITEMS) -> DataFrame:
    """The batch twin."""
    w = Window.partitionBy("job_id").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0)
    df = _early(df, pages, candidates)
    free = F.col("verdict").isNull()
    asks = free & F.col("detail")
    df = df.withColumns({"n": F.count_if(free).over(w), "d": F.count_if(asks).over(w)})
    verdict = F.coalesce("verdict", F.when(F.col("n") > items, "items").when(asks & (F.col("d") > details), "details").otherwise("taken"))
    return df.select("job_id", "page", "place", "url", verdict.alias("verdict"), F.when(free, F.col("n")).otherwise(0).cast("long").alias("n"))


def cursors(verdicts: DataFrame) -> DataFrame:
    """(job_id, taken, page, place, url): what a job took and where its next run begins, if it left anything."""
    left = F.min(F.when(F.col("verdict") != "taken", F.struct("page", "place", "url"))).alias("c")
    df = verdicts.groupBy("job_id").agg(F.count_if(F.col("verdict") == "taken").alias("taken"), left)
    return df.select("job_id", "taken", "c.page", "c.place", "c.url")


def batches_within(items: DataFrame, limit: int = BATCH) -> DataFrame:
    """Landed items of files of `limit` items or fewer: a batch beyond that is rejected whole. For a stream's foreachBatch or a table."""
    own = Window.partitionBy("file")
    return items.withColumn("_n", F.count("*").over(own)).where(F.col("_n") <= limit).drop("_n")


# --- counts of a run -----------------------------------------------------------------------------------------------


def metered(df: DataFrame, name: str, accepted: Column) -> DataFrame:
    """`df`, batch or stream, that counts what goes by: no pass of its own."""
    return df.observe(name, F.count(F.lit(1)).alias("received"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))


class RunMetrics(StreamingQueryListener):
    """Collects the counts of each micro-batch of the streams metered under one of `names`."""

    def __init__(self, *names: str):
        self.names, self.rows = names, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name in self.names:
            if (m := p.observedMetrics.get(name)) is not None and p.numInputRows:
                self.rows.append((name, str(p.runId), p.batchId, m["received"], m["accepted"], m["rejected"]))

    def onQueryTerminated(self, event) -> None:
        pass
