import pytest

from bindery.plans import catalog_queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_agrees_with_sql(name, agrees):
    agrees(q.QUERIES[name], q.ORACLE[name])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_queries_have_no_sql():
    assert set(q.QUERIES) - set(q.ORACLE) == {"nfkc_keys", "page_prices", "title_buckets"}


def test_exists_becomes_a_semi_join_and_nothing_is_a_product(spark):
    from tests.conftest import DATA

    assert "LeftSemi" in plan(q.QUERIES["books_filtered_newest"](spark, DATA))
    assert "LeftAnti" in plan(q.QUERIES["orphan_works"](spark, DATA))
    for name in ("active_listings_page", "directory_people", "duplicate_people_pairs", "homepage_verification"):
        assert "Join Cross" not in plan(q.QUERIES[name](spark, DATA))


def test_filters_and_columns_reach_the_scan(spark):
    from tests.conftest import DATA

    physical = q.QUERIES["person_books_by_year"](spark, DATA, only="person_id <= 100")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_custkey,100)" in physical
    assert "o_totalprice" not in physical and "p_retailprice" not in physical


def test_cursor_pages_make_the_whole_sort(spark):
    from pyspark.sql import functions as F

    from bindery.plans import browse
    from tests.conftest import DATA

    df = browse.marketplace_offers(spark, DATA).select("observed_at", "listing_id").cache()
    order = [F.desc("observed_at"), "listing_id"]
    whole, got, cursor = [tuple(r) for r in df.orderBy(*order).limit(60).collect()], [], None
    while len(got) < 60:
        page = df if cursor is None else df.where(browse.after_cursor(F.col("observed_at"), F.col("listing_id"), (F.lit(cursor[0]), F.lit(cursor[1]))))
        got += [tuple(r) for r in page.orderBy(*order).limit(20).collect()]
        cursor = got[-1]
    assert got == whole


def test_nfkc_keys_match_the_standard_library(spark):
    import unicodedata

    from bindery.functions import texts

    words = ["ＡＢＣ　１２", "ﾊﾝｶｸ", "Straße", "é", "", None, "～x～"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(texts.nfkc_key("w")).collect()]
    assert got == [None if w is None else "".join(c for c in unicodedata.normalize("NFKC", w).casefold() if c.isalnum()) for w in words]


def test_work_sets_are_equal_by_real_ids(spark, tmp_path):
    """1 and 2 have works 1 and 2; 3 has 51 and 52."""
    lines = [(p, w) for p, ws in ((1, (1, 2)), (2, (1, 2)), (3, (51, 52))) for w in ws]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p, "3-MEDIUM") for p in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in q.QUERIES["identical_work_sets"](spark, str(tmp_path)).collect()] == [("1,2", 2, 2, 1)]


def test_pairs_of_people_by_brute_force(spark, tmp_path):
    """One work credits everybody, so pairs can't come from it alone."""
    import random
    from itertools import combinations

    r = random.Random(1)
    of = {p: {0, *r.sample(range(1, 30), r.randint(0, 4))} for p in range(40)}
    spark.createDataFrame([(p, w) for p, ws in of.items() for w in ws], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p, "3-MEDIUM") for p in of], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = [(a, b, len(of[a] & of[b]), len(of[a]), len(of[b])) for a, b in combinations(of, 2) if len(of[a] & of[b]) >= 2]
    assert sorted(map(tuple, q.QUERIES["duplicate_people_pairs"](spark, str(tmp_path)).collect())) == want


def test_pairs_of_people_in_crowds(spark, tmp_path, monkeypatch):
    """Pairs that share small works, crowds of any order, and one of each."""
    from bindery.plans import audit

    for crowd in (0, 3, 8, 39):
        monkeypatch.setattr(audit, "CROWD", crowd)
        path = tmp_path / str(crowd)
        path.mkdir()
        test_pairs_of_people_by_brute_force(spark, path)
    monkeypatch.setattr(audit, "CROWD", 1000)
    # Without crowds no lists of works are joined to pairs.
    assert "array_intersect" not in q.QUERIES["duplicate_people_pairs"](spark, str(path))._jdf.queryExecution().optimizedPlan().toString()


def test_ordinals_over_ranges(spark):
    from bindery.operators import ordinals

    df = spark.createDataFrame([((i * 7919) % 1000, i % 5) for i in range(1000)], "k long, n long").repartition(7)
    assert sorted((r.k, r.at) for r in ordinals.numbered(df, ["k"], "at").collect()) == [(i, i + 1) for i in range(1000)]
    total, want = 0, []
    for k, n in sorted((r.k, r.n) for r in df.collect()):
        want.append((k, total))
        total += n
    assert sorted((r.k, r.at) for r in ordinals.running(df, ["k"], "n", "at").collect()) == want
    assert ordinals.numbered(df.where("k < 0"), ["k"], "at").count() == 0
