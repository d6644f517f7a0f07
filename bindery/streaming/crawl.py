"""Where a crawl stops: a page seen before, or five pages in a row without a match.

A run's pages are numbered from 1 without gaps and may come in any order. A page is judged when all before it have been; until then it waits
in the state. The first status that isn't `running` ends the run: pages after it are dropped, and so is the run's state of
waiting pages and fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: pages in a row without a match that end a search.
IRRELEVANT = 5
STATUS = "run string, page int, streak int, first_page int, status string"


def fingerprint(urls: Column) -> Column:
    """Of a page, known by its list of addresses."""
    return F.sha2(F.to_json(urls).cast("binary"), 256)


class Crawl(StatefulProcessor):
    """One run: what it expects next, the pages that wait, and where each fingerprint was seen first."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "page int, streak int, ended boolean")
        self.waiting = handle.getListState("waiting", "page int, fingerprint string, matches long, more boolean")
        self.first = handle.getValueState("first", "page int")
        self.seen = handle.getMapState("seen", "fingerprint string", "page int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Pages that can't be judged yet are appended to those that wait, in one call; these are read only when the page they wait for is there."""
        page, streak, ended = self.at.get() or (1, 0, False)
        out, new, known, began = [], {}, {}, page
        if ended:
            return
        for pdf in rows:
            new |= {int(p): (f, int(m), bool(more)) for p, f, m, more in zip(pdf["page"], pdf["fingerprint"], pdf["matches"], pdf["more"], strict=True)}
        first = (self.first.get() or (None,))[0]  # of those that wait
        held = first is not None
        while not ended:
            if held and page >= first and (page not in new or page > first):
                new = {p: tuple(x) for p, *x in self.waiting.get()} | new
                held = False
            if page not in new:
                break
            fp, matches, more = new.pop(page)
            streak = 0 if matches else streak + 1
            if fp not in known:
                known[fp] = (self.seen.getValue((fp,)) or (None,))[0] if began > 1 else None
            before = known[fp]
            if before is None:
                known[fp] = page
                self.seen.updateValue((fp,), (page,))
            status = "public_search_exhausted" if not more else "query_relevance_exhausted" if streak >= self.limit else "pagination_stalled" if before is not None else "running"
            out.append((key[0], page, streak, before, status))
            page, ended = page + 1, status != "running"
        if ended:
            self.waiting.clear()
            self.first.clear()
            self.seen.clear()
        else:
            new = {p: x for p, x in new.items() if p >= page}
            if held and new:
                self.waiting.appendList([(p, *x) for p, x in new.items()])
                self.first.update((min(first, min(new)),))
            elif not held and new:
                self.waiting.put([(p, *x) for p, x in new.items()])
                self.first.update((min(new),))
            elif not held:
                self.waiting.clear()
                self.first.clear()
        self.at.update((page, streak, ended))
        if out:
            yield self._told(out)

    @staticmethod
    def _told(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["run", "page", "streak", "first_page", "status"]).astype({"page": "int32", "streak": "int32", "first_page": "Int32"})

    def close(self) -> None:
        pass


def _pages(df: DataFrame) -> DataFrame:
    return df.select(F.col("run").cast("string").alias("run"), F.col("page").cast("int").alias("page"), fingerprint(F.col("urls")).alias("fingerprint"), F.col("matches").cast("long").alias("matches"), "more")


def crawled_stream(stream: DataFrame, limit: int = IRRELEVANT) -> DataFrame:
    """Statuses of a stream of pages (run, page, urls, matches, more), once each, until a run ends."""
    return _pages(stream).groupBy("run").transformWithStateInPandas(Crawl(limit), outputStructType=STATUS, outputMode="Append", timeMode="None")


def crawled(df: DataFrame, limit: int = IRRELEVANT) -> DataFrame:
    """The batch twin, by windows."""
    run = Window.partitionBy("run").orderBy("page")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    df = _pages(df).withColumn("place", F.row_number().over(run)).where("place = page")
    df = df.withColumns({"island": F.count_if(F.col("matches") > 0).over(so_far), "found": F.min("page").over(Window.partitionBy("run", "fingerprint"))})
    island = Window.partitionBy("run", "island").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"streak": F.count_if(F.col("matches") == 0).over(island).cast("int"), "first_page": F.when(F.col("found") < F.col("page"), F.col("found"))})
    status = F.when(~F.col("more"), "public_search_exhausted").when(F.col("streak") >= limit, "query_relevance_exhausted").when(F.col("first_page").isNotNull(), "pagination_stalled").otherwise("running")
    df = df.withColumn("status", status).withColumn("end", F.min(F.when(F.col("status") != "running", F.col("page"))).over(Window.partitionBy("run")))
    return df.where("end IS NULL OR page <= end").select("run", "page", "streak", "first_page", "status")
