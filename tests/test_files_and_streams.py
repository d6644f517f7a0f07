import datetime as dt
import json

from pyspark.sql import functions as F

from bindery.operators import lifecycle
from bindery.sources import files
from bindery.streaming import feed
from tests.conftest import DATA

ITEM = {"externalId": "e1", "status": "active", "priceMinor": 5, "priceComponents": [{"basis": "list", "priceMinor": 5, "currency": "JPY", "condition": ""}]}


def test_batches_and_captures(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"m{i}").mkdir()
        (tmp_path / f"m{i}" / "home.json").write_text(json.dumps({"jobId": f"j{i}", "sourceId": "s", "pageNumber": i, "items": [ITEM, ITEM | {"externalId": "e2"}]}))
    df = files.read_batches(spark, f"{tmp_path}/*/home.json")
    assert sorted((r.jobId, r.position, r.externalId, r.priceComponents[0].basis) for r in df.collect()) == [(f"j{i}", p, f"e{p + 1}", "list") for i in range(2) for p in range(2)]
    assert sorted(r.capture for r in files.read_captures(spark, f"{tmp_path}/*/home.json", files.BATCH).collect()) == ["m0", "m1"]


def test_rss_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<rss><channel><item><title>A</title><dc:date type="x">2024</dc:date><category>p</category><category>q</category></item><item><title>B</title></item></channel></rss>')
    got = files.read_items(spark, f"{tmp_path}/a.xml").select("title", "category").collect()
    assert [tuple(r) for r in got] == [("A", ["p", "q"]), ("B", None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("g", "b", [1]), ("g", "a|x", [2])], "g string, t string, n array<int>")
    files.write_csv_report(df, f"{tmp_path}/csv")
    files.write_json_report(df, f"{tmp_path}/json")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.startswith("﻿g,t,n\n") and "[2]" in text
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert files.markdown_lines(df, "g", "t").first()["markdown"] == "## g\n\n- a\\|x\n- b"


def test_stream_drops_replays_and_keeps_the_latest(spark, tmp_path):
    src, out = tmp_path / "in", f"{tmp_path}/state"
    rows = [("a", "k1", 1), ("a", "k2", 2), ("b", "k3", 1)]
    for i, part in enumerate([rows, [*rows[:1], ("a", "k4", 5)]]):
        df = spark.createDataFrame([(k, o, v, dt.datetime(2024, 1, 1)) for k, o, v in part], "key string, obs string, v int, ts timestamp").coalesce(1)
        df.write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    unique = feed.unique_observations(stream, "obs", "ts")
    counts = []
    sink = feed.latest_sink(spark, out, ["key"], ["v"])
    q = unique.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, i: (counts.append(b.count()), sink(b, i))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(counts) == 4
    last = feed.previous(spark, out, 10)
    assert sorted((r.key, r.v) for r in last.collect()) == [("a", 5), ("b", 1)]


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.read.parquet(f"{DATA}/events.parquet")
    status = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "purchase", "completed").otherwise("ended")
    rows = e.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("observed_at"), status.alias("status"),
        F.lit("physical").alias("format"), F.when(F.col("user_id") % 2 == 0, "auction").otherwise("bookstore").alias("kind"), (F.col("value") * 100).cast("long").alias("price_minor"),
    )
    for i in range(2):
        rows.where(F.col("arrival") < 500 if i == 0 else F.col("arrival") >= 500).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = []
    q = feed.lifecycle_stream(stream, "key").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, i: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    latest = {}
    for r in out:
        if r.key not in latest or r.observations > latest[r.key].observations:
            latest[r.key] = r
    want = {r.key: r for r in lifecycle.fold(rows, "key", ["arrival"]).collect()}
    assert set(latest) == set(want)
    for k, r in want.items():
        assert tuple(latest[k])[1:] == (r.observations, r.is_active, r.asking_minor, r.sold_minor, r.sold_review), k


def test_lifecycle_state_takes_nulls():
    """Null prices and kinds, as the batch fold takes them."""
    import pandas as pd

    class Value:
        def __init__(self):
            self.v = None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    state = feed.Lifecycle()
    state.state = Value()
    rows = [("active", "physical", None, 5.0), ("active", "physical", "auction", None), ("completed", "physical", "auction", None), ("excluded", "physical", "auction", 3.0)]
    pdf = pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["arrival", "status", "format", "kind", "price_minor"])
    out = next(state.handleInputRows(("k",), iter([pdf.head(1)]), None)).iloc[0]
    assert out["observations"] == 1 and pd.isna(out["is_active"])
    out = next(state.handleInputRows(("k",), iter([pdf.tail(3)]), None)).iloc[0]
    assert out["observations"] == 4 and not out["is_active"] and pd.isna(out["asking_minor"]) and pd.isna(out["sold_minor"]) and out["sold_review"] == "excluded"


def test_digest_pages_and_blocks(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    works = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id int, at timestamp")
    assert [r.id for r in feed.digest(works, "at", t[0], t[2]).orderBy("id").collect()] == [1, 2]
    assert feed.digest(works, "at", None, t[2]).count() == feed.digest(works, "at", t[0], t[0] + dt.timedelta(hours=3)).count() == 0
    pages = spark.createDataFrame([("r", 1, ["a"]), ("r", 2, ["b"]), ("r", 3, ["a"]), ("s", 1, ["a"])], "run string, page int, urls array<string>")
    assert [(r.run, r.page) for r in feed.repeated_pages(pages, "run", "page", "urls").collect()] == [("r", 3)]
    blocks = spark.createDataFrame([(1, t[0]), (1, t[2]), (2, t[0])], "source_id int, blocked_at timestamp")
    assert [r.source_id for r in feed.blocked_sources(blocks, t[3] - dt.timedelta(hours=1)).collect()] == [1]
    assert feed.uncovered(pages, pages.where("page = 1"), "run").count() == 0
