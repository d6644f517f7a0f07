"""Streams against their batch twins: out of order, stopped and started again, and with timers that fire."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from bindery.storage import Scratch
from bindery.streaming import clocks, cooldown, crawl, intake, run

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_parts(spark, scratch, df, stream, parts, stops=1, runs=run.drained):
    """The stream's output over `parts` landings, with the query stopped and started again after each `stops` of them."""
    path, out, checkpoint = (scratch.folder(x) for x in ("landings", "out", "checkpoint"))
    bare = df.drop("part")
    wanted = None
    for first in range(0, parts, stops):
        run.land(df, path, F.col("part"), min(stops, parts - first), first)
        wanted = stream(run.landed(spark, path, bare.schema))
        runs(wanted, out, checkpoint)
    return spark.read.schema(wanted.schema).parquet(out)


@pytest.fixture
def scratch(spark):
    s = Scratch(spark)
    yield s
    s.close()


def pages(runs, r):
    out = []
    for k in range(runs):
        for p in range(1, r.randint(2, 14)):
            out.append((f"r{k}", p, [r.choice("abcdefghij"), r.choice("xyz")], r.choice([0, 0, 0, 1]), r.random() > 0.04))
    return out


def test_crawl_in_any_order_equals_windows(spark, scratch):
    r = random.Random(4)
    data = pages(25, r) + [("gap", 1, ["a"], 1, True), ("gap", 3, ["b"], 1, True), ("five", 1, ["q"], 1, True)] + [("five", p, [str(p)], 0, True) for p in range(2, 10)]
    df = spark.createDataFrame([(*x, r.randrange(4)) for x in data], "run string, page int, urls array<string>, matches int, more boolean, part int")
    got = in_parts(spark, scratch, df, crawl.crawled_stream, 4, 2)
    want = crawl.crawled(df)
    assert rows(got) == rows(want)
    statuses = {(x.run, x.page): x.status for x in want.collect()}
    assert statuses["five", 6] == "query_relevance_exhausted" and ("five", 7) not in statuses
    assert statuses["gap", 1] == "running" and ("gap", 3) not in statuses
    assert {"pagination_stalled", "public_search_exhausted"} <= set(statuses.values())


def test_repeated_irrelevant_page_at_the_limit_is_exhausted(spark):
    """Relevance is judged before repetition, and the end of a search before both."""
    data = [("a", p, ["same" if p > 4 else str(p)], 0, True) for p in range(1, 7)] + [("b", p, [str(p)], 0, p < 5) for p in range(1, 7)]
    df = spark.createDataFrame(data, "run string, page int, urls array<string>, matches int, more boolean")
    last = {x.run: (x.page, x.status) for x in crawl.crawled(df).orderBy("page").collect()}
    assert last == {"a": (5, "query_relevance_exhausted"), "b": (5, "public_search_exhausted")}


def test_limits_survive_restarts(spark, scratch):
    data = [(f"j{j}", p, i, f"/{j}/{p}/{i}", (i + p) % 3 == 0, (p - 1) // 2) for j in range(4) for p in range(1, 8) for i in range(1, 4 + 7 * j)]
    df = spark.createDataFrame(data, "job_id string, page int, place int, url string, detail boolean, part int")
    small = {"pages": 6, "candidates": 20, "details": 15, "items": 60}
    got = in_parts(spark, scratch, df, lambda s: intake.limited_stream(s, **small), 4)
    want = intake.limited(df.drop("part"), **small)
    assert rows(got) == rows(want)
    assert set(r.verdict for r in want.collect()) == {"taken", "pages", "candidates", "details", "items"}
    cursors = {r.job_id: r for r in intake.cursors(want).collect()}
    assert cursors["j0"].page == 7 and cursors["j0"].taken == 18
    assert all(c.taken <= 60 for c in cursors.values())


def test_large_batches_are_rejected_whole(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(6)], "file string, i int")
    assert {r.file for r in intake.batches_within(df, 5).collect()} == {"a"}


def test_stream_counts_without_a_second_pass(spark, scratch):
    """The listener's counts of each micro-batch are those of the landings."""
    listener = intake.RunMetrics("run")
    spark.streams.addListener(listener)
    try:
        df = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("part"))
        path = run.land(df, scratch.folder("in"), F.col("part"), 3)
        stream = intake.metered(run.landed(spark, path, "id long"), "run", F.col("id") < 40)
        done = run.drained(stream, scratch.folder("out"), scratch.folder("checkpoint"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(50):
            if len(listener.rows) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(x[2:] for x in listener.rows) == [(0, 30, 14, 16), (1, 30, 13, 17), (2, 30, 13, 17)]
    assert len([p for p in done.recentProgress if p["numInputRows"]]) == 3


def test_two_clocks_take_files_in_any_order(spark, scratch):
    r = random.Random(9)
    data = []
    for i in range(300):
        data.append((f"k{r.randrange(12)}", i, T0 + dt.timedelta(hours=r.randrange(200)), r.choice(["active", "ended", "completed"]), r.choice(["physical", "digital"]), r.randrange(1000), r.randrange(3)))
    df = spark.createDataFrame(data, "key string, arrival long, observed_at timestamp, status string, format string, price_minor long, part int")
    for mode in clocks.MODES:
        path = run.land(df, scratch.folder("in"), F.col("part"), 3)
        updates = run.updated(clocks.two_clocks(run.landed(spark, path, df.drop("part").schema), mode), scratch.folder("out"), scratch.folder("checkpoint"))
        got = {x.key: x for x in clocks.latest_versions(updates).collect()}
        for key in {d[0] for d in data}:
            own = [d for d in data if d[0] == key]
            shown = max(own, key=lambda d: d[1] if mode == "arrival" else (d[2], d[1]))
            sales = [d for d in own if d[3] == "completed" and d[4] == "physical"]
            sale = max(sales, key=lambda d: (d[2], d[1])) if sales else None
            x = got[key]
            assert (x.observations, x.status, x.price_minor, x.observed_at) == (len(own), shown[3], shown[5], shown[2])
            assert (x.sold_minor, x.sold_at) == ((sale[5], sale[2]) if sale else (None, None))


def visits(n, r):
    t, out = T0, []
    for i in range(n):
        t += dt.timedelta(minutes=r.randrange(0, 200))
        out.append((f"s{r.randrange(6)}", t, i, r.choice([None, None, None, "challenge"]), min(i * 3 // n, 2)))
    return out


def test_cooldown_equals_its_batch_twin_over_restarts(spark, scratch):
    df = spark.createDataFrame(visits(200, random.Random(2)), "source_id string, at timestamp, seq long, reason string, part int")
    got = in_parts(spark, scratch, df, cooldown.cooled_stream, 3, runs=run.settled)
    want = cooldown.cooled(df.drop("part"))
    assert rows(got.where("event <> 'released'")) == rows(want)
    assert {r.event for r in want.collect()} == {"blocked", "held", "open"}


def test_a_timer_releases_after_the_cooldown_and_a_restart(spark, scratch):
    """Two blocks of a few seconds: the query is stopped before they end, and the one started again releases each source once."""
    seconds, path, out, checkpoint = 6, scratch.folder("in"), scratch.folder("out"), scratch.folder("checkpoint")
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    df = spark.createDataFrame([("a", now, 0, "challenge"), ("b", now, 1, "login"), ("c", now, 2, None)], "source_id string, at timestamp, seq long, reason string")
    df.coalesce(1).write.mode("append").parquet(path)
    stream = lambda: cooldown.cooled_stream(run.landed(spark, path, df.schema), seconds / 3600)
    run.settled(stream(), out, checkpoint)
    told = lambda: sorted((r.source_id, r.event) for r in spark.read.schema(cooldown.EVENTS).parquet(out).collect())
    before = [("a", "blocked"), ("b", "blocked"), ("c", "open")]
    assert [x for x in told() if x[1] != "released"] == before
    for _ in range(5):  # a loaded machine may stop a run before its first micro-batch is done
        run.settled(stream(), out, checkpoint, seconds + 4)
        if len(told()) >= 5:
            break
    assert told() == sorted([*before, ("a", "released"), ("b", "released")])
    run.settled(stream(), out, checkpoint, 1)
    assert len(told()) == 5


def test_scratch_goes_with_the_session(spark):
    import os

    s = Scratch(spark)
    df = s.put(spark.range(5), "x")
    assert df.count() == 5 and os.path.isdir(s.root)
    s.drop(df)
    assert not os.path.exists(df._stored_at)
    s.close()
    assert not os.path.exists(s.root)


def test_scratch_goes_when_the_process_ends(tmp_path):
    import os
    import subprocess
    import sys

    code = "\n".join([
        "from bindery.session import session", "from bindery.storage import Scratch",
        f"spark = session('local[1]', 1, **{{'spark.ui.enabled': 'false', 'spark.checkpoint.dir': 'file://{tmp_path}'}})",
        "s = Scratch(spark); s.put(spark.range(3)); import os; print('THERE', os.listdir(s.root.removeprefix('file://')))",
    ])
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "THERE ['1-t']" in said.stdout, said.stderr[-2000:]
    assert [x for x in os.listdir(tmp_path) if x.startswith("bindery-")] == []


def test_landings_of_several_files(spark, scratch):
    """All tasks write a landing, and each landing has as many files as the others, empty ones too."""
    path = scratch.folder("in")
    df = spark.range(0, 4000, 1, 4).selectExpr("id", "IF(id < 3990, 0, 1) AS part")
    files = run.spread(df, path, F.col("part"), 3)
    assert files == 4 and len(spark.read.schema(df.schema).parquet(path).inputFiles()) == 3 * files
    stream = run.landed(spark, path, df.schema, files).groupBy("part").count()
    out = scratch.folder("out")
    seen = run.updated(stream, out, scratch.folder("checkpoint"))
    assert sorted(map(tuple, seen.collect())) == [(0, 3990), (1, 10)]


def test_visits_of_a_source_are_sorted_over_all_frames():
    import pandas as pd

    from types import SimpleNamespace

    state = SimpleNamespace(exists=lambda: False, get=lambda: None, update=lambda x: None)
    c = cooldown.Cooldown(3600)
    c.handle, c.block = SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None), state
    day = pd.Timestamp("2024-01-01")
    frames = [pd.DataFrame({"at": [day + pd.Timedelta(minutes=m)], "seq": [m], "reason": [why]}) for m, why in ((10, None), (5, "challenge"))]
    (got,) = c.handleInputRows(("a",), iter(frames), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0))
    assert list(got["event"]) == ["blocked", "held"]
