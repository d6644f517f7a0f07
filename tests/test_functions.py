import datetime as dt

import pytest
from pyspark.sql import functions as F

from bindery.functions import extract, ids, offers, texts
from bindery.operators import lifecycle, matching, permissions, upsert


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "structured", "currency", "region", "expected"),
    [
        ("価格 ¥1,200 税込", "", "", "JP", (1200, "JPY")),
        ("¥ 88.50", "", "", "CN", (8850, "CNY")),
        ("售價 350元", "", "", "TW", (35000, "TWD")),
        ("$12.345 shipped", "", "", "US", (1235, "USD")),
        ("$12", "", "", "MY", (1200, "MYR")),
        ("US$12", "", "", "TW", (1200, "USD")),
        ("price: 40", "", "", "JP", (40, "JPY")),
        ("¥999", "1,500", "JPY", "JP", (1500, "JPY")),
        ("nothing", "-3", "JPY", "JP", (0, "JPY")),
    ],
)
def test_prices(spark, text, structured, currency, region, expected):
    df = spark.createDataFrame([(text, structured, currency, region)], "t string, s string, c string, r string")
    assert tuple(df.select(extract.parsed_price(*map(F.col, "tscr")).alias("p")).first()["p"]) == expected


@pytest.mark.parametrize(
    ("text", "operation", "status"),
    [
        ("Add to cart", "active_discovery", "active"),
        ("Sold out. Add to cart", "active_discovery", "ended"),
        ("120 items sold, in stock", "listing_reconcile", "active"),
        ("Winning bid ¥1", "sold_discovery", "completed"),
        ("Winning bid, cancelled", "sold_discovery", "unknown"),
        ("In stock. 商品説明 売り切れ", "active_discovery", "active"),
        ("", "sold_discovery", "unknown"),
    ],
)
def test_status(spark, text, operation, status):
    df = spark.createDataFrame([(text, operation)], "t string, o string")
    assert df.select(extract.evident_status(F.col("t"), F.col("o"))["status"]).first()[0] == status


@pytest.mark.parametrize(
    ("title", "names", "expected"),
    [
        ("New Anna Bell photobook", ["Anna Bell"], ("named", "")),
        ("Annabella", ["Anna"], ("absent", "")),
        ("Anna in spring", ["Anna"], ("weak", "")),
        ("山田花 写真集", ["花"], ("other", "山田花")),
        ("花のアルバム", ["花"], ("weak", "")),
        ("花ここ写真集", ["花"], ("other", "花ここ")),
        ("なし", ["山田花子"], ("absent", "")),
        ("", ["x y"], ("absent", "")),
    ],
)
def test_title_class(title, names, expected):
    assert extract.title_class(title, names) == expected


def test_title_class_runs_as_a_udf(spark):
    df = spark.createDataFrame([("Anna Bell live", ["Anna Bell"]), (None, None)], "t string, n array<string>")
    assert [tuple(r[0]) for r in df.select(extract.classify_title("t", "n")).collect()] == [("named", ""), ("absent", "")]


def test_credit_segments_and_decomposition(spark, tmp_path):
    from bindery.operators import credits

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    lists = {"花子,Hanako": 5, "花子,Hanako,Guest": 1, "月子,Tsukiko": 3, "月子,Tsukiko,花子,Hanako": 2, "김,이,박": 4, "Solo": 9, "花子, hanako": 2, "": 1}
    df = spark.createDataFrame(list(lists.items()), "list string, works long")
    segments = credits.credit_segments(df)
    assert sorted((tuple(r.segment), r.works) for r in segments.collect()) == [(("月子", "Tsukiko"), 3), (("花子", "Hanako"), 5)]
    got = credits.decompose(spark.createDataFrame([("月子,tsukiko,花子,Hanako,Guest",), ("Solo",)], "list string"), segments).orderBy("list", "at").collect()
    assert [(r.list, tuple(r.part), r.known) for r in got] == [
        ("Solo", ("Solo",), False), (got[1].list, ("月子", "Tsukiko"), True), (got[1].list, ("花子", "Hanako"), True), (got[1].list, ("Guest",), False),
    ]


@pytest.mark.parametrize(
    ("title", "code"),
    [
        ("Ａ　ＤＶＤ", "disc_only"), ("DVD付き 写真集", None), ("2024 calendar", "calendar_only"), ("calendar photo book", None), ("Illustrated guide", "illustrated_book"),
        ("生成AI 写真集", "synthetic_subject"), ("paid illumination", None), ("週刊現代 3号", "magazine_only"), (None, None), ("", None), ("ヤングジャンプ", None), ("ヤングジャンプ 12号", "magazine_or_supplement"),
        ("写真集 [中古 DVD]", "disc_only"), ("DVD photo album", None), ("ジュニア 水着", "junior_gravure"), ("２０２４年５月号 写真集", "magazine_only"),
    ],
)
def test_title_exclusions(spark, title, code):
    from bindery.functions import rules

    assert spark.createDataFrame([(title,)], "t string").select(rules.title_exclusion(F.col("t"))).first()[0] == code


def test_rules_about_offers(spark):
    from bindery.functions import rules

    lit = lambda *x: F.array(*map(F.lit, x))
    far = "paperback with a bonus " + "x" * 150 + " ebook"
    assert [one(spark, rules.inferred_format(F.lit(t), F.lit(k))) for t, k in ((far, "bookstore"), ("paperback with ebook bonus", "bookstore"), ("plain", "digital_store"), ("紙本", "digital_store"), ("", "auction"))] == [
        "digital", "physical", "digital", "physical", "physical",
    ]
    assert one(spark, rules.subject_matches(F.lit("Ａnna Bell 写真集 other"), lit("Anna Bell"))) is True
    assert one(spark, rules.subject_matches(F.lit("Other 写真集 Anna Bell"), lit("Anna Bell"))) is False
    assert one(spark, rules.search_names(lit("Anna Bell"), lit("Anna", "Annie B.", "ベル", "鈴の子", "ANNA BELL", "Annie B"))) == ["Anna Bell", "Annie B.", "鈴の子"]
    assert one(spark, rules.label_fits(F.lit("Summer days"), F.lit("Summer Days vol. one (press) [e-book]"))) is True
    assert one(spark, rules.label_fits(F.lit("Summer"), F.lit("Summer days of another year"))) is False
    assert one(spark, rules.label_fits(F.lit("Asuka"), F.lit("Asuka (x)"))) is True and one(spark, rules.label_fits(F.lit("Asuk"), F.lit("Asuka"))) is False
    assert one(spark, rules.cover_url(lit("https://x.example/RESTRICTED.JPG?1", "https://x.example/a_mask.png", "https://x.example/b.png"))) == "https://x.example/b.png"
    assert [str(one(spark, rules.moment(F.lit(t)))) for t in ("1700000000", "1700000000000", "2024年3月5日 7:08", "２０２４/3/5", "x", "2024-13-40")] == [
        "2023-11-14 22:13:20", "2023-11-14 22:13:20", "2024-03-05 07:08:00", "2024-03-05 00:00:00", "None", "None",
    ]
    assert one(spark, rules.labelled_amount(F.lit("最低落札価格 5円 落札価格：1,200円"), rules.SOLD_LABELS)) == 1200
    assert one(spark, rules.store_item(F.lit("https://www.example.org/search?q=1"))) is None
    assert tuple(one(spark, rules.store_item(F.lit("https://m.example.org/product/ab-1.html?x=2")))) == ("product_page", "ab-1", "https://www.example.org/product/ab-1")


def test_short_aliases_need_their_context(spark):
    """A short Latin title counts when quoted or beside the word for a photobook; others by containment; ties match nothing."""
    titles = ["写真集「Asuka」", "asuka 写真集", "写真集 Asuka", "Asuka Kirara book", "写真集 Asuka Kirara", "Golden  Harbour", "golden harbour 2冊", "Golden Harbour Asuka 写真集 asuka"]
    items = spark.createDataFrame([(i, t, None) for i, t in enumerate(titles)], "item_id int, title string, isbn string")
    books = spark.createDataFrame([(1, "Asuka", ""), (2, "Golden Harbour", ""), (3, "", ""), (4, None, "1")], "book_id int, alias string, isbn string")
    assert sorted(map(tuple, matching.match_books(items, books).collect())) == [(0, 1, "title"), (1, 1, "title"), (2, 1, "title"), (5, 2, "title")]


def test_formats_prices_and_delays(spark):
    lit = F.lit
    assert one(spark, offers.normal_format(lit(" E-Book "))) == "digital"
    assert one(spark, offers.normal_format(lit("vinyl"))) == ""
    assert one(spark, offers.minor_units(lit("10.005"), lit("USD"))) == 1001
    assert one(spark, offers.minor_units(lit("10.5"), lit("JPY"))) == 11
    assert one(spark, offers.price_category(lit("physical"), lit("bookstore"), lit("completed"))) == "physical_retail"
    assert one(spark, offers.price_category_with_used(lit("physical"), lit("bookstore"), lit("active"), lit("[중고] x"))) == "marketplace_asking"
    assert [one(spark, offers.retry_delay(lit(n))) for n in (1, 2, 7, 30)] == [15, 30, 960, 960]
    assert [one(spark, offers.lease_seconds(lit(n))) for n in (0, 60, 9000)] == [300, 60, 3600]


def test_dates(spark):
    day = F.lit("2024-05-17").cast("timestamp")
    assert one(spark, offers.partial_date(day, F.lit("month"))) == dt.datetime(2024, 5, 1)
    assert one(spark, offers.partial_date(day, F.lit("year"))) == dt.datetime(2024, 1, 1)
    assert one(spark, offers.sourced_date_problem(F.lit(None).cast("timestamp"), F.lit("day"), F.lit(""))) == "date_missing"
    assert one(spark, offers.sourced_date_problem(day, F.lit("day"), F.lit("http://x"))) == "source_missing"
    assert one(spark, offers.sourced_date_problem(day, F.lit("day"), F.lit("https://x/"))) is None
    start, end = offers.day_bounds(F.lit("2024-01-01 20:00:00").cast("timestamp"), "Asia/Tokyo")
    assert one(spark, start) == dt.datetime(2024, 1, 1, 15) and one(spark, end) == dt.datetime(2024, 1, 2, 14, 59, 59)


def test_components(spark):
    schema = "c array<struct<basis:string,price_minor:long,currency:string,condition:string>>"
    part = lambda b, p=5, cur="JPY", cond="": (b, p, cur, cond)
    cases = [
        ([part("list"), part("sale", 4)], None, "sale"), ([part("list"), part("list")], "repeated_basis", "list"), ([part("coupon")], "coupon_condition", "coupon"),
        ([part("list"), part("used_asking")], "used_not_alone", "list"), ([part("list"), part("sale", 4, "USD")], "currencies_differ", "sale"), ([part("sale", -1)], "negative", "sale"),
    ]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], schema)
    got = df.select(offers.components_problem(F.col("c")), offers.primary_component(F.col("c"))["basis"]).collect()
    assert [tuple(r) for r in got] == [(p, b) for _, p, b in cases]


def test_ids_and_urls(spark):
    import hashlib

    want = "listing-" + hashlib.sha256(b"src\0ext").hexdigest()[:32]
    assert one(spark, ids.listing_id(F.lit("src"), F.lit("ext"))) == want
    assert one(spark, ids.wide_trim(F.lit("　 a 　"))) == "a"
    assert one(spark, texts.canonical_url(F.lit("HTTPS://A.Example/x/?utm_source=f#top"))) == "https://a.example/x"
    assert one(spark, texts.external_id(F.lit("https://shop.test/items/ab-1"))) == "ab-1"
    assert one(spark, texts.host_allowed(F.lit("https://evil-example.org/"), F.array(F.lit("example.org")))) is False


@pytest.mark.parametrize(
    ("title", "code"),
    [("EX大衆デジタル写真集 A", None), ("EX大衆デジタル写真集付き", "magazine_only"), ("EX大衆デジタル写真集 イラスト", "illustrated_book"), ("EX大衆 5月", "magazine_only"), ("漫画アクション グラビアン魂 写真集", None), ("デジタル写真集 DVD写真集[x]", "disc_only")],
)
def test_digital_books_under_magazine_brands(spark, title, code):
    from bindery.functions import rules

    assert one(spark, rules.digital_title_exclusion(F.lit(title))) == code


@pytest.mark.parametrize(
    ("title", "yes"),
    [("写真集 (bonus poster)", True), ("photobook with postcard", True), ("写真集 トレカ", False), ("生写真", False), ("写真 カード", False), ("寫真集 卡片", True), ("相簿", False), ("artbook 写真", True), ("artbook 画册", False), ("car model photo book", False), ("novel", False), (None, False)],
)
def test_photobooks_by_title(spark, title, yes):
    from bindery.functions import rules

    assert one(spark, rules.looks_like_photobook(F.lit(title))) is yes


def test_upsert_is_idempotent(spark):
    state = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    batch = spark.createDataFrame([(2, "", 2), (3, "c", 2), (3, "d", 3)], "k int, v string, t int")
    once = upsert.upsert(state, batch, ["k"], [F.desc("t")], keep_filled=("v",))
    twice = upsert.upsert(once, batch, ["k"], [F.desc("t")], keep_filled=("v",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "b", 2), (3, "d", 3)]
    seen = upsert.insert_absent(state, batch, ["k"], ["t"])
    assert seen.count() == upsert.insert_absent(seen, batch, ["k"], ["t"]).count() == 3
    with pytest.raises(ValueError):
        upsert.assert_none(state, "violations")


TRACE = [("active", 10), ("ended", 10), ("completed", 9), ("active", 12), ("excluded", 12)]


def test_lifecycle_trace(spark):
    rows = [("a", i, dt.datetime(2024, 1, 1 + i), s, "physical", "auction", p) for i, (s, p) in enumerate(TRACE)]
    df = spark.createDataFrame(rows, "key string, arrival int, observed_at timestamp, status string, format string, kind string, price_minor long")
    state = [lifecycle.fold(df.where(f"arrival < {n}"), "key", ["arrival"]).first() for n in range(1, 6)]
    assert [r["is_active"] for r in state] == [True, False, False, True, False]
    assert [r["sold_minor"] for r in state] == [None, None, 9, 9, 9]
    assert state[3]["sold_review"] == "linked" and state[4]["sold_review"] == "excluded"
    assert all(r["active_at"] == dt.datetime(2024, 1, 1) for r in state) and state[4]["inactive_reason"] == "excluded"


def test_grants_and_matching(spark):
    cols = "status string, method string, reviewed_at timestamp, effective_at timestamp, expires_at timestamp, purpose string, rate int, retention string, display_mode string, attribution string, allowed_fields array<string>, allowed_uses array<string>"
    t = dt.datetime(2024, 1, 1)
    good = ("approved", "letter", t, t, None, "catalog", 1, "permanent", "link", "source", ["title"], ["display"])
    df = spark.createDataFrame([good, ("pending", *good[1:]), (*good[:4], dt.datetime(2024, 2, 1), *good[5:]), (*good[:10], [], good[11])], cols)
    array = lambda *x: F.array(*map(F.lit, x))
    got = [r[0] for r in df.select(permissions.grant_problem(F.lit(dt.datetime(2024, 3, 1)), array("title"), array("display"))).collect()]
    assert got == [None, "status", "expired", "fields"]
    items = spark.createDataFrame([(1, "x", "978-1"), (2, "Golden Harbour special", ""), (3, "まとめ Golden Harbour", ""), (4, "「Asuka」 book", ""), (5, "Asuka live", None)], "item_id int, title string, isbn string")
    books = spark.createDataFrame([(10, "Golden Harbour", "9781"), (11, "Asuka", "")], "book_id int, alias string, isbn string")
    assert sorted(map(tuple, matching.match_books(items, books).collect())) == [(1, 10, "isbn"), (2, 10, "title"), (4, 11, "title")]


def test_table_function(spark):
    extract.register_all(spark)
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(("◆Regular Card 81種", "◆Regular Card 81種", "note", "Signed cards: 12種類"))], "release string, place int, line string")
    got = spark.sql("SELECT c.* FROM composition_groups(TABLE({lines}) PARTITION BY release ORDER BY place) AS c", lines=lines).collect()
    assert [(r.sequence, r.title, r.announced) for r in got] == [(1, "Regular Card", 81), (2, "Regular Card", 81), (3, "Signed cards", 12)]


def test_titles_without_their_brand(spark):
    from bindery.functions import rules

    df = spark.createDataFrame([("$$$$ Press one", "$$$$ Press"), ("Brand#12 $$$$", "Brand#12"), ("Brand#12 DVD", "Brand#12")], "t string, b string")
    assert [x[0] for x in df.select(rules.brand_exclusion(F.col("t"), F.col("b"))).collect()] == [None, "symbols", None]


def test_batch_limits_sort_no_batch(spark):
    from bindery.plans import guards

    plan = guards.QUERIES["batch_limits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_marks_leave_no_title_out(spark):
    """Titles of the words of all rules are judged as without the marks; a title without a mark meets one pattern only."""
    import random
    import re

    from bindery.functions import rules

    words = [w for _, p, _ in rules.TITLE_RULES for w in re.split(r"\\s\*|\\s\+|\(\?i\)|\(\?:|[|()\[\]^$]|\.\*|\\b|\\", p) if w] + ["Photo CD", "FRIDAY GOLD", "GRAVURE MAGAZINE", "AI-generated", "Blu-ray", "illustrated", "Jr.", "2024年5月号", "3枚", "12号", "été"]
    r = random.Random(3)
    titles = [(w,) for w in words] + [(r.choice(["", " "]).join(r.choice(words) for _ in range(r.randint(1, 4))),) for _ in range(1500)]
    t = spark.createDataFrame(titles, "t string")
    got = t.select(rules.title_exclusion(F.col("t")).alias("a"), rules.title_exclusion(F.col("t"), list(rules.TITLE_RULES)).alias("c")).collect()
    assert all(x.a == x.c for x in got) and len({x.a for x in got}) > 5
    plan = t.select(rules.title_exclusion(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "dvd|blu|gravure" in plan  # tried before the rules


def test_name_keys_go_by_slices():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"doc_id": list(range(250)), "text": ["Ａ é", None, "ß 写"] + ["x"] * 247})
    got = list(texts.name_keys(iter([b])))
    assert [x.num_rows for x in got] == [100, 100, 50]
    assert got[0].slice(0, 3).to_pylist() == [{"doc_id": 0, "key": "aé", "spaced": "aé", "width": 4}, {"doc_id": 1, "key": None, "spaced": None, "width": 0}, {"doc_id": 2, "key": "ss写", "spaced": "ß写", "width": 4}]
