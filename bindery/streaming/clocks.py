"""A listing under two clocks: arrival decides what it shows, evidence time decides what is known of its sale.

Rows are (key, arrival, observed_at, status, format, price_minor); arrivals are numbered by whoever received them. In the
mode `arrival` the listing shows the last arrival, even if it was observed earlier than what it shows; in the mode `event_time` it shows the
latest observation. A sale takes the evidence of a completed, physical observation unless it has later one already, by time
of observation, in either mode. Both are maxima under a total order, so files may come in any order, and the same plan
is a batch query and a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = {"arrival": ("arrival",), "event_time": ("observed_at", "arrival")}


def two_clocks(df: DataFrame, mode: str = "arrival") -> DataFrame:
    """The listing and its sale, one row for each key; of a stream, in update mode, after each micro-batch."""
    shown = F.max_by(F.struct("status", "price_minor", "observed_at", "arrival"), F.struct(*MODES[mode])).alias("shown")
    evidence = (F.col("status") == "completed") & (F.col("format") == "physical")
    sale = F.max_by(F.struct("price_minor", "observed_at"), F.when(evidence, F.struct("observed_at", "arrival"))).alias("sale")
    out = df.groupBy("key").agg(F.count("*").alias("observations"), shown, sale)
    return out.select("key", "observations", "shown.status", "shown.price_minor", "shown.observed_at", F.col("sale.price_minor").alias("sold_minor"), F.col("sale.observed_at").alias("sold_at"))


def latest_versions(updates: DataFrame) -> DataFrame:
    """Of the updates that a stream has written, the last of each key: the one that has seen most observations."""
    rest = [c for c in updates.columns if c not in ("key", "observations")]
    best = updates.groupBy("key").agg(F.max("observations").alias("observations"), F.max_by(F.struct(*rest), "observations").alias("v"))
    return best.select("key", "observations", "v.*")
