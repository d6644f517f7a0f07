"""Components, merges, spans, grants, evidence, names and compositions, on golden cases and against brute force."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bindery.functions import compositions, releases
from bindery.operators import evidence, grants, intervals, manifest, merging, naming
from bindery.operators.components import components
from bindery.storage import Scratch


@pytest.fixture
def scratch(spark):
    s = Scratch(spark)
    yield s
    s.close()


def rooted(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_components(spark, scratch, kind):
    r = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(20)], "star": [(99, i) for i in range(40)] + [(200, 201)], "random": [(r.randrange(90), r.randrange(90)) for _ in range(60)],
        "loops": [(3, 3), (4, 4), (3, 4), (4, 3), (8, 8)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {x.node: x.root for x in components(scratch, df).collect()} == rooted(edges)


def test_components_of_nothing(spark, scratch):
    df = spark.createDataFrame([(None, 1), (2, None)], "a long, b long")
    assert components(scratch, df).collect() == []


def test_merges_follow_chains_and_wait_for_members(spark):
    works = spark.createDataFrame([(1, "published", ["Ann"]), (2, "published", ["Bea", "Ann"]), (3, "published", ["Cid"]), (4, "published", ["Dee"]), (5, "published", None), (7, "published", ["Eve"])], "work_id long, status string, featured_names array<string>")
    editions = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4), (60, 1), (70, 7)], "edition_id long, work_id long")
    credits = spark.createDataFrame([(1, 9, "featured"), (2, 9, "featured"), (3, 8, "cover"), (4, 9, "featured")], "work_id long, person_id long, role string")
    people = spark.createDataFrame([(9,)], "person_id long")
    groups = spark.createDataFrame([
        ("a", 1, 9, 2, 20), ("b", 2, 9, 3, 30),  # a chain: 3 into 2 into 1
        ("c", 1, 9, 4, 40), ("c", 1, 9, 5, 50),  # an edition that isn't there: the group waits, 4 included
        ("d", 1, 8, 7, 70),  # a person who isn't there
        ("e", 99, 9, 7, 70),  # a work that isn't there
        ("f", 1, 9, 6, 60),  # a member's work is gone, but its edition has moved already
        ("g", 2, 9, 6, 60),  # the same edition for another work: not reviewed
    ], "group_id string, work_id long, person_id long, member_id long, edition_id long")
    out = merging.merge_works(spark, works, editions, credits, people, groups)
    assert {r.group_id: r.reason for r in out.deferred.collect()} == {"c": "edition", "d": "person", "e": "work", "g": "member"}
    assert {r.work_id: r.into for r in out.targets.collect()} == {2: 1, 3: 1, 6: 1}
    assert {r.edition_id: r.work_id for r in out.editions.collect()} == {10: 1, 20: 1, 30: 1, 40: 4, 60: 1, 70: 7}
    assert {r.work_id: (r.status, r.featured_names) for r in out.works.collect()} == {
        1: ("published", ["Ann", "Bea", "Cid"]), 2: ("superseded", ["Bea", "Ann"]), 3: ("superseded", ["Cid"]), 4: ("published", ["Dee"]), 5: ("published", None), 7: ("published", ["Eve"]),
    }
    assert sorted(tuple(r) for r in out.credits.collect()) == [(1, 8, "cover"), (1, 9, "featured"), (4, 9, "featured")]


DAY = dt.datetime(2020, 1, 1)


def test_interval_join_equals_brute_force(spark):
    """Spans from an hour to decades, open ones, edges and keys with many spans."""
    r = random.Random(6)
    at = lambda: DAY + dt.timedelta(hours=r.randrange(24 * 900))
    spans = [(r.choice("ab"), s := at(), r.choice([None, s, s + dt.timedelta(hours=r.choice([1, 24, 25, 700, 9000, 300_000]))]), i) for i in range(400)]
    points = [(r.choice("abc"), at(), i) for i in range(300)] + [("a", spans[0][1], 900), ("a", DAY, 901)]
    p, s = spark.createDataFrame(points, "k string, t timestamp, p int"), spark.createDataFrame(spans, "k string, since timestamp, until timestamp, s int")
    want = sorted((b, d) for k, t, b in points for kk, x, y, d in spans if k == kk and x <= t and (y is None or t < y))
    got = intervals.interval_join(p, s, ["k"], "t", "since", "until")
    assert sorted((x.p, x.s) for x in got.collect()) == want
    semi = {x.p for x in intervals.interval_join(p, s, ["k"], "t", "since", "until", how="left_semi").collect()}
    anti = {x.p for x in intervals.interval_join(p, s, ["k"], "t", "since", "until", how="left_anti").collect()}
    assert semi == {b for b, _ in want} and semi | anti == {b for _, _, b in points} and not semi & anti
    union = intervals.merged(s, ["k"], "since", "until")
    again = {x.p for x in intervals.interval_join(p, union, ["k"], "t", "since", "until").collect()}
    assert again == semi
    islands = collections.defaultdict(list)
    for x in union.collect():
        islands[x.k].append((x.since, x.until))
    assert all(a[1] is not None and a[1] < b[0] for k in islands for a, b in zip(sorted(islands[k]), sorted(islands[k])[1:]))


NOW = dt.datetime(2026, 11, 1, 12)
GRANT = {
    "source_id": "kolis", "scope": "bibliography", "status": "approved", "access_method": "API", "allowed_fields": "title,url,format", "purpose": "indexing", "allowed_uses": "collect,retain,catalog_display", "retention_mode": "permanent",
    "retention_days": 0, "retention_policy": "retain", "display_mode": "attributed", "attribution_required": True, "attribution_text": "Source", "redistribution_allowed": False, "rate_per_minute": 6, "rightsholder": "library",
    "territory": "Global", "evidence_url": "https://data.example/api", "effective_at": NOW - dt.timedelta(hours=1), "expires_at": NOW + dt.timedelta(hours=1), "reviewed_at": NOW - dt.timedelta(hours=1),
}
GRANTS = (
    "source_id string, scope string, status string, access_method string, allowed_fields string, purpose string, allowed_uses string, retention_mode string, retention_days int, retention_policy string, display_mode string, attribution_required boolean, "
    "attribution_text string, redistribution_allowed boolean, rate_per_minute int, rightsholder string, territory string, evidence_url string, effective_at timestamp, expires_at timestamp, reviewed_at timestamp"
)


@pytest.mark.parametrize("change, fields, uses, at, want", [
    ({}, ["title", "URL "], ["collect", "catalog_display"], NOW, None),
    ({}, ["title", "cover_image"], ["collect"], NOW, "fields"),
    ({}, ["title"], ["collect", "redistribute"], NOW, "uses"),
    ({"allowed_uses": "collect,redistribute"}, ["title"], ["redistribute"], NOW, "redistribution"),
    ({}, ["title"], ["collect"], NOW + dt.timedelta(hours=1), "expired"),
    ({}, ["title"], ["collect"], NOW - dt.timedelta(hours=2), "not_effective"),
    ({"expires_at": None}, ["title"], ["collect"], NOW + dt.timedelta(days=900), None),
    ({"retention_mode": "temporary", "retention_days": 30}, ["title"], ["collect", "retain"], NOW, "retention"),
    ({"retention_mode": "temporary", "retention_days": 30}, ["title"], ["collect"], NOW, None),
    ({"retention_mode": "Temporary "}, ["title"], ["collect"], NOW, "retention_days"),
    ({"status": "pending"}, ["title"], ["collect"], NOW, "status"),
    ({"access_method": "html"}, ["title"], ["collect"], NOW, "method"),
    ({"reviewed_at": None}, ["title"], ["collect"], NOW, "not_reviewed"),
    ({"display_mode": "none"}, ["title"], ["catalog_display"], NOW, "display"),
    ({"display_mode": "framed"}, ["title"], ["collect"], NOW, "display_mode"),
    ({"attribution_text": " "}, ["title"], ["collect"], NOW, "attribution"),
    ({"attribution_required": False}, ["title"], ["collect"], NOW, "attribution"),
    ({"evidence_url": "https://user@data.example/"}, ["title"], ["collect"], NOW, "evidence_url"),
    ({"evidence_url": "http://data.example/"}, ["title"], ["collect"], NOW, "evidence_url"),
    ({"rate_per_minute": 0}, ["title"], ["collect"], NOW, "rate"),
    ({"territory": None}, ["title"], ["collect"], NOW, "territory"),
    ({"scope": "used_prices"}, ["title"], ["collect"], NOW, "scope"),
    ({"source_id": "other"}, ["title"], ["collect"], NOW, "source"),
])
def test_grants_allow_only_what_they_say(spark, change, fields, uses, at, want):
    g = spark.createDataFrame([tuple((GRANT | change).values())], GRANTS)
    reason = grants.denial(F.lit("kolis"), F.lit("api"), F.lit("bibliography"), grants.names(*fields), grants.names(*uses), F.lit(at))
    assert g.select(reason.alias("r")).first()["r"] == want


def test_scopes_and_fields_of_observations(spark):
    none = F.lit(None).cast("string")
    parts = lambda basis: F.array(F.struct(F.lit(basis).alias("basis")))
    empty = F.expr("cast(array() as array<struct<basis:string>>)")
    s = lambda status, basis, price, c, kind="", money="": grants.observation_scope(F.lit(status), F.lit(basis), F.lit(price), c, F.lit(kind), F.lit(money))
    row = spark.range(1).select(
        s("active", "", 9600, empty, money="KRW").alias("a"), s("Completed", "", 9600, empty).alias("b"), s("active", "used_asking", 9600, empty).alias("c"), s("active", "", 0, parts("used_asking")).alias("d"),
        s("", "", 0, empty).alias("e"), s("", "", 0, empty, "fixed").alias("f"), grants.observation_scopes(F.lit("current_prices"), F.lit("https://image.example/c.jpg")).alias("g"),
        grants.observation_fields(F.lit("active"), F.lit("978"), none, F.lit(" "), F.lit(0), parts("list"), F.lit("good"), none, F.lit("free"), F.lit("https://i.example/")).alias("h"),
        grants.observation_fields(none, none, none, none, F.lit(None).cast("long"), F.lit(None).cast("array<struct<basis:string>>"), none, none, none, none).alias("i"),
    ).first()
    assert row[:7] == ("current_prices", "used_prices", "used_prices", "used_prices", "bibliography", "current_prices", ["current_prices", "product_images"])
    assert row.h == ["title", "url", "format", "observed_at", "availability", "isbn", "price", "currency", "price_basis", "price_components", "condition", "shipping", "image_url"]
    assert row.i == ["title", "url", "format", "observed_at"]


def test_ten_thousand_grants_of_one_source(spark):
    """Now and at capture, by one grant for all fields of a capture."""
    r = random.Random(8)
    sets = ["title,url", "title,url,price", "Title, price ", "format"]
    rows = []
    for i in range(10_000):
        start = NOW - dt.timedelta(hours=r.randrange(1, 20_000))
        end = r.choice([None, NOW + dt.timedelta(hours=r.randrange(1, 9000)), NOW - dt.timedelta(minutes=r.randrange(1, 900))])
        rows.append(GRANT | {"allowed_fields": sets[i % 4] if i < 9998 else "isbn", "effective_at": start, "reviewed_at": start + dt.timedelta(hours=r.randrange(50)), "expires_at": end, "status": "approved" if i % 3 else "revoked"})
    wants = [["title"], ["title", "price"], ["URL", "price"], ["format"], ["format", "title"], ["isbn"]]
    captures = [("kolis", "bibliography", NOW - dt.timedelta(hours=r.randrange(-1, 25_000), minutes=i), f) for i in range(250) for f in [r.choice(wants)]]
    flat = [(s, c, t, f) for s, c, t, fs in captures for f in fs]
    df = grants.authorized(spark.createDataFrame(flat, "source_id string, scope string, captured_at timestamp, field string"), spark.createDataFrame([tuple(x.values()) for x in rows], GRANTS), spark.createDataFrame([("kolis", "api")], "source_id string, method string"), F.lit(NOW))
    good = [x for x in rows if x["status"] == "approved" and x["effective_at"] <= NOW and (x["expires_at"] is None or x["expires_at"] > NOW)]
    low = [(x, {f.strip().lower() for f in x["allowed_fields"].split(",")}) for x in good]

    def verdict(t, fields):
        need = {f.lower() for f in fields}
        able = [x for x, have in low if need <= have]
        if t > NOW + dt.timedelta(minutes=1):
            return "future"
        if not able:
            return "no_grant"
        return "authorized" if any(max(x["effective_at"], x["reviewed_at"]) <= t and (x["expires_at"] is None or t < x["expires_at"]) for x in able) else "not_then"

    assert {x.captured_at: x.verdict for x in df.collect()} == {t: verdict(t, fs) for _, _, t, fs in captures}
    assert len({x.verdict for x in df.collect()}) >= 3


RECORD = (
    "record_id long, work struct<id:string,title:string,origin:string,summary:string,featured_names:string,cover_url:string,issue_date:timestamp,issue_date_precision:string,issue_date_source_url:string>, "
    "edition struct<id:string,work_id:string,metadata_source_url:string,format:string,isbn:string,page_count:int,release_date:timestamp,release_precision:string>, featured_people array<struct<slug:string,verification_source_url:string>>, "
    "edition_media array<struct<media_type:string,source_url:string>>, featured_credit_source_url string, cover_credit_source_url string, " + evidence.EVIDENCE
)
META = "https://meta.example/1"


def test_evidence_is_read_from_the_schema(spark):
    day = dt.datetime(2024, 1, 1)
    give = lambda kind, eid, scope, url, *fields: (kind, eid, "s", scope, url, day, list(fields))
    full = [
        give("work", "w1", "bibliography", META, "title", "origin", "featured_names"), give("work_image", "w1", "product_images", META, "cover_url"), give("work", "w1", "bibliography", "https://dates.example/", "issue_date", "issue_date_precision"),
        give("edition", "e1", "bibliography", META, "metadata_source_url", "format", "isbn", "page_count", "release_date", "release_precision"), give("person", "p", "bibliography", "https://people.example/p", "identity"),
        give("work_credit", "w1", "bibliography", META, "featured:p"), give("edition_image", "e1", "product_images", "https://media.example/1", "sample"),
    ]
    work = ("w1", "T", "", " ", "P", "c.jpg", day, "day", "https://dates.example/")
    edition = ("e1", "w1", META, "physical", "978", 96, day, "day")
    record = lambda i, given, w=work, e=edition, media=(("sample", "https://media.example/1"),): (i, w, e, [("p", "https://people.example/p")], list(media), " ", None, given)
    changed = [x for x in full if x[0] != "person"] + [give("work", "w1", "bibliography", META, " title "), give("edition", "e1", "used_prices", META, "language")]
    changed[1] = give("work_image", "w1", "bibliography", META, "cover_url")
    changed[2] = give("work", "w1", "bibliography", META, "issue_date", "issue_date_precision")
    rows = [record(1, full), record(2, changed), record(3, full, media=[("sample", "https://media.example/1"), ("sample", "https://media.example/2")]), record(4, full, e=("e1", "w1", "http://meta.example/1", *edition[3:])), (5, None, None, None, None, None, None, None)]
    got = collections.defaultdict(set)
    for x in evidence.evidence_mismatches(spark.createDataFrame(rows, RECORD)).collect():
        got[x.record_id].add((x.entity_type, x.entity_id, x.field, x.gap))
    assert got[1] == set() and got[5] == set()
    assert got[2] == {
        ("person", "p", "identity", "missing"), ("work", "w1", "title", "duplicate"), ("edition", "e1", "language", "extra"), ("work_image", "w1", "cover_url", "scope"), ("work", "w1", "issue_date", "url"), ("work", "w1", "issue_date_precision", "url"),
    }
    assert got[3] == {("edition_image", "e1", "sample", "conflict")}
    assert {g for *_, g in got[4]} == {"unsourced"} and len(got[4]) == 11
    assert evidence.expected_evidence(spark.createDataFrame(rows[:1], RECORD)).count() == 15


def test_evidence_deals_records_out_once_and_nulls_meet_nothing(spark):
    give = lambda entity, eid, *fields: (entity, eid, "s1", "bibliography", META, None, list(fields))
    work, edition = ("w1", "T", "", " ", "P", "c.jpg", None, None, None), ("e1", "w1", META, "physical", "978", 96, None, None)
    rows = [(None, work, edition, None, None, " ", None, [give("work", "w1", "title")]), (2, work, edition, None, None, " ", None, [give(None, "w1", "title", "title"), None, ("work", "w1", "s1", "bibliography", META, None, None)])]
    df = evidence.evidence_mismatches(spark.createDataFrame(rows, RECORD))
    got = sorted((x.record_id or 0, x.entity_type or "", x.gap) for x in df.collect() if x.field == "title")
    assert got == [(0, "work", "extra"), (0, "work", "missing"), (2, "", "duplicate"), (2, "work", "missing")]
    assert df._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and df._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange ") == 1


TITLES = [
    ("MOMO 藤田もも写真集", ["もも", "Momo"], "other", "藤田もも"), ("FLASHデジタル写真集　鈴もも　永遠少女", ["もも", "Momo"], "other", "鈴もも"), ("A-collection 萌木七海（１）", ["兒玉七海", "七海", "Nanami"], "other", "萌木七海"),
    ("PHOTO SHOT　〜レースクイーン〜　七海ひより", ["兒玉七海", "七海"], "other", "七海ひより"), ("LOVEPOP デラックス　美ノ嶋めぐり　001", ["めぐり", "Meguri"], "other", "美ノ嶋めぐり"),
    ("Exciting Girls 橋本梨菜デジタル写真集 Vol.1", ["橋本梨菜"], "named", ""), ("志田音々ファースト写真集『nene』", ["志田音々"], "named", ""), ("Nanami「Departure」", ["兒玉七海", "Nanami"], "weak", ""),
    ("[ハレム]もも from 63ANGEL", ["もも"], "weak", ""), ("12th Birthday Party!", ["もも", "Momo"], "absent", ""), ("Momoka Collection", ["Momo"], "absent", ""), ("七海の休日", ["七海"], "weak", ""), ("ANNA LEE photobook", ["Anna Lee", "Anna"], "named", ""),
]


def test_names_in_titles(spark):
    """Every title against every person, in one pass: the golden pairs have the golden classes."""
    t = spark.createDataFrame([(i, x[0]) for i, x in enumerate(TITLES)] + [(99, None)], "title_id int, title string")
    p = spark.createDataFrame([(i, x[1]) for i, x in enumerate(TITLES)] + [(99, None)], "person_id int, names array<string>")
    got = {(x.title_id, x.person_id): (x["class"], x.proposed) for x in naming.classify_titles(spark, t, p).collect()}
    for i, (_, _, kind, longer) in enumerate(TITLES):
        assert got.get((i, i), ("absent", "")) == (kind, longer), TITLES[i]
    assert got[0, 1] == ("other", "藤田もも") and (5, 0) not in got


def test_names_by_passes_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(naming, "PASS_BYTES", 20)
    test_names_in_titles(spark)


def test_titles_counted_for_people_as_classified_in_pairs(spark):
    """Copies of titles, people with one name, with equal names and with names of two classes in one title."""
    texts = [x[0] for x in TITLES] * 2 + ["Momo Anna lee と 鈴もも", "藤田もも もも", "Anna Lee", "anna leeds anna", "七海 Anna", None]
    names = [("Anna Lee", "Anna"), ("もも", "Momo"), ("Momo", "もも"), ("七海", "もも"), ("Anna", "anna "), ("Anna Lee", "もも"), ("Anna Lee", ""), (None, "七海"), ("", None), ("Anna Lee", "Anna")]
    t = spark.createDataFrame(list(enumerate(texts)), "title_id int, title string")
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(names)], "person_id int, whole string, short string")
    pairs = naming.classify_titles(spark, t, p.select("person_id", F.array("whole", "short").alias("names")))
    want = sorted(map(tuple, pairs.groupBy("person_id", "class").agg(F.count("*").alias("titles")).collect()))
    assert {x[1] for x in want} == {"named", "other", "weak"} and sorted(map(tuple, naming.count_titles(spark, t, p).collect())) == want


def test_titles_and_people_of_equal_names_make_no_pairs(spark):
    """100,000 titles of 100,000 people with the same names would make 10 billion pairs."""
    n = 100_000
    t = spark.range(n).select(F.lit("anna lee momo").alias("title"))
    p = spark.range(n).select("id", F.lit("anna lee"), F.lit("momo")).toDF("person_id", "whole", "short")
    assert [tuple(x) for x in naming.count_titles(spark, t, p).groupBy("class").agg(F.count("*"), F.max("titles")).collect()] == [("named", n, n)]


def test_accented_single_words_are_short_names(spark):
    names = spark.createDataFrame([("öé",), ("éé øß",), ("ü2",), ("&&",), ("김지수",), ("兒玉七海",), ("七海",), ("もも",)], "name string")
    assert [x[0] for x in names.select(naming.is_short(F.col("name"))).collect()] == [True, False, True, True, False, False, True, True]
    t, p = spark.createDataFrame([(0, "ciób a-ciób"), (1, "a ció ñ")], "title_id int, title string"), spark.createDataFrame([(0, ["ció"])], "person_id int, names array<string>")
    assert [x.title_id for x in naming.classify_titles(spark, t, p).collect()] == [1]


COMPOSITIONS = [
    ("商品構成 全178類（予定）\n◆Regular Card 72種\n◆Rare Card 38種★\n・Autograph Card（A）＜3種＞\n・Sexy Lingerie Bra in Card ＜5種＞\n長浜みつりプロフィール\n◆After 9種", 178, [("Regular Card", 72), ("Rare Card", 38), ("Autograph Card（A）", 3), ("Sexy Lingerie Bra in Card", 5)], {3: "Rare Card"}),
    ("NBA 2018/2019 カード\n全127種類（予定）\n?Regular Card（レギュラーカード）：81種類\n?Super Rare Card\n・Autograph Card（直筆サインカード）：3種類\n※種類数、商品仕様は変更になる場合があります。\nMLB 2026カード", 127, [("Regular Card（レギュラーカード）", 81), ("Autograph Card（直筆サインカード）", 3)], {}),
    ("商品構成 全155種類（予定）\n◆1of1 Card 13種★\n・Brassiere Hook in Card＜8種＞\nプロフィール", 155, [("1of1 Card", 13), ("Brassiere Hook in Card", 8)], {}),
    ("<Collect All 332 Cards>\n[SPECIAL INSERT CARDS]\n● Base Autograph Set: 8 cards\nType A [Limited to 250] 4種類 [各250枚限定]\nType B [Limited to 200] 4種類 [各200枚限定]\n※パックには332種類のカードがランダムに入っています。", 332, [("Base Autograph Set", 8), ("Type A", 4), ("Type B", 4)], {1: "Special Insert Cards", 2: "Base Autograph Set"}),
    ("◆Rare Card 3種\n・x Card 2種\n・x Card 2種\n◆Rare Card 3種", 0, [("Rare Card", 3), ("x Card", 2), ("Rare Card", 3)], {}),
    ("", 0, [], {}), (None, 0, [], {}),
]


def test_compositions_of_releases(spark):
    df = spark.createDataFrame([(str(i), x[0]) for i, x in enumerate(COMPOSITIONS)], "release string, text string")
    totals = {r.release: r.n for r in df.select("release", compositions.announced_total(F.coalesce("text", F.lit(""))).alias("n")).collect()}
    got = collections.defaultdict(list)
    for r in compositions.compositions(spark, compositions.composition_lines(df)).orderBy("release", "sequence").collect():
        got[r.release].append(r)
    for i, (_, total, groups, sections) in enumerate(COMPOSITIONS):
        own = got[str(i)]
        assert totals[str(i)] == total and [(r.title, r.announced) for r in own] == groups
        assert [r.code for r in own] == [f"COMP-{k + 1:03d}" for k in range(len(own))]
        assert all(own[k - 1].section == s for k, s in sections.items())


def test_card_codes(spark):
    rows = [("a", 1, "Signed CJ-12 and CJ 13"), ("a", 2, "regular CARD CJ13, CJ-14, VOL3 of 2024, #7"), ("a", 3, None), ("a", 4, "price RC-9"), ("b", 1, "PAGE 4 RC-001 rare xRC-2"), ("b", 2, "card no. 12, autograph")]
    got = compositions.card_codes(spark.createDataFrame(rows, "release string, place int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "CJ-12", "signed"), ("a", 2, "CJ13", "signed"), ("a", 3, "CJ-14", "regular"), ("a", 4, "7", "regular"), ("b", 1, "RC-001", "rare"), ("b", 2, "12", "autograph")]


RELEASES = [
    ("COLLECTION CARDS PLUS #9 2020年3月5日発売 12,800円", "plus:9", 9, None, "2020-03-05", []),
    ("series VOL. 2 8 on sale 2019/11/02", "volume:28", 28, None, "2019-11-02", []),
    ("シリーズ 第12弾 予約受付中", "volume:12", 12, None, None, []),
    ("THE LUXURY EDITION 2021 (after VOL.30)", "the-luxury:2021", None, "the-luxury", None, []),
    ("ラグジュアリー 2018年11月", "luxury:2018", None, "luxury", "2018-11", []),
    ("ＤＥＬＵＸＥ ２０２２ 出演：山田花子、 鈴木もも ＆ Anna Lee", "deluxe:2022", None, "deluxe", None, ["山田花子", "鈴木もも", "Anna Lee"]),
    ("10th Anniversary set, cast: Mia Q, Eva R, 3 box 1,000円", "anniversary:10:unknown", None, None, None, ["Mia Q", "Eva R"]),
    ("15周年 2023.1.9", "anniversary:15:2023", None, None, "2023-01-09", []),
    ("2,020円 の本", None, None, None, None, []), ("", None, None, None, None, []), (None, None, None, None, None, []),
]


def test_identities_of_releases(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(RELEASES)], "id int, text string")
    for r in releases.release_identities(df).orderBy("id").collect():
        assert (r.identity, r.volume, r.edition, r.released, r.people) == RELEASES[r.id][1:], RELEASES[r.id]
        assert all(0 <= x.start < x.end <= len(r.text) for x in r.finds)
        assert all(a.end <= b.start for a, b in zip(r.finds, r.finds[1:]))
        for x in r.finds:
            if x.kind == "cast":
                assert r.text[x.start : x.end] == x.value


def test_manifest_rules(spark):
    """A sound record breaks nothing; each change breaks its own rule."""
    import copy

    day = dt.datetime(2024, 1, 1)
    sound = {
        "record_id": 0, "work": {"id": "w", "title": "T", "origin": "JP", "publication_type": "", "featured_names": "P"}, "edition": {"id": "e", "work_id": "w", "metadata_source_url": "https://m.example/", "format": "physical"},
        "featured_people": [{"slug": "p", "verification_source_url": "https://p.example/"}], "cover_people": None, "featured_credit_source": None, "source_id": "s", "batch_source_id": "s",
        "items": [{"edition_id": "e", "format": "physical", "status": "active", "currency": "JPY", "price_basis": "list", "price_minor": 5}],
    }
    part = lambda b, n=5, c="JPY": {"basis": b, "price_minor": n, "currency": c, "condition": ""}
    changes = [
        ({}, []), ({"featured_people": [{"slug": "", "verification_source_url": "https://p.example/"}]}, ["featured_people"]), ({"featured_people": sound["featured_people"] * 2}, ["featured_people"]),
        ({"cover_people": [{"slug": "c", "verification_source_url": "http://c.example/"}]}, ["cover_people"]), ({"featured_credit_source": "rumour"}, ["credit_source"]), ({"work.publication_type": "poster"}, ["publication_type"]),
        ({"work.publication_type": "magazine_issue", "work.issue_month": "2024-13"}, ["issue_identity"]),
        ({"work.publication_type": "magazine_issue", "work.issue_month": "2024-12", "cover_people": sound["featured_people"]}, []),
        ({"work.featured_names": " "}, ["photobook_identity"]), ({"work.issue_number": "7"}, ["photobook_identity"]), ({"edition.publication_date": day}, ["publication_date"]),
        ({"edition.store_release_date_precision": "day"}, ["store_release_date"]), ({"edition.publication_date": day, "edition.publication_date_precision": "month", "edition.publication_date_source_url": "https://d.example/"}, []),
        ({"work.origin": "KR", "edition.release_date": day}, ["ambiguous_release_date"]), ({"edition.release_date": day}, []), ({"work.title": "a ?? b"}, ["catalog_identity"]), ({"edition.work_id": "x"}, ["catalog_identity"]), ({"work.origin": None}, ["catalog_identity"]),
        ({"edition.format": "vinyl"}, ["format", "listing_mismatch"]), ({"edition.cover_url": "https://a.example/x_mask.png?w=1"}, ["warning_cover"]), ({"edition.original_cover_url": "https://a.example/restricted.jpg"}, []),
        ({"edition.cover_url": "https://a.example/x.png", "edition.original_cover_url": "https://a.example/restricted.jpg"}, ["warning_cover"]), ({"batch_source_id": "t"}, ["source_mismatch"]), ({"items.edition_id": "f"}, ["listing_mismatch"]),
        ({"items.status": "completed"}, ["price"]), ({"items.price_components": [part("list"), part("list")]}, ["price"]), ({"items.price_components": [part("list", 9)]}, ["price"]), ({"items.price_components": [part("list")]}, []),
        ({"work.origin": "KR", "items.price_basis": ""}, ["price"]), ({"items.price_basis": ""}, []), ({"work": None, "edition": None}, ["linked_observation"]), ({"work": None, "edition": None, "items.edition_id": None}, []), ({"items": None, "source_id": None}, []),
    ]
    rows = []
    for i, (change, _) in enumerate(changes):
        r = copy.deepcopy(sound) | {"record_id": i}
        for path, value in change.items():
            head, _, rest = path.partition(".")
            if not rest:
                r[head] = value
            elif head == "items":
                r["items"][0][rest] = value
            else:
                r[head][rest] = value
        rows.append(r)
    schema = spark.createDataFrame([], manifest.RECORD).schema
    got = collections.defaultdict(list)
    for x in manifest.manifest_problems(spark.createDataFrame(rows, schema)).collect():
        got[x.record_id].append(x.problem)
    for i, (change, want) in enumerate(changes):
        assert sorted(got[i]) == sorted(want), change


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_go_to_levels_that_spans_have(spark):
    """Spans of one length make one row of each point, not one for each level there could be."""
    hour = dt.timedelta(hours=1)
    p = spark.createDataFrame([("a", DAY + hour / 2, 1)], "k string, t timestamp, p int")
    s = spark.createDataFrame([("a", DAY, DAY + hour, 1)], "k string, since timestamp, until timestamp, s int")
    assert [x.s for x in intervals.interval_join(p, s, ["k"], "t", "since", "until").collect()] == [1]
    assert "explode([0,1" not in _plan(intervals.interval_join(p, s, ["k"], "t", "since", "until"))
    assert intervals.interval_join(p, s.where("s > 1"), ["k"], "t", "since", "until").count() == 0


def test_rules_without_their_marks_are_not_looked_at(monkeypatch):
    tried = []
    over = releases._over_gaps
    monkeypatch.setattr(releases, "_over_gaps", lambda pattern, text: tried.append(text) or over(pattern, text))
    assert releases.release_finds("a plain title of no release") == [] and not tried
    assert [x[3] for x in releases.release_finds("2024年1月2日 PLUſ 3")] == ["2024-01-02", "plus:3"] and len(tried) == 2


def test_compositions_are_folded_in_batches(spark):
    """As the table function does, but without a call for each line."""
    lines = [("a", 2, "・one Card ＜3種＞"), ("a", 1, "[RARE CARDS]"), ("b", 1, "◆two Card 4種★"), ("b", 2, "・three Card 5種"), (None, 1, "x 7種類"), ("b", 3, "◆two Card 4種★"), ("a", 3, None)]
    df = spark.createDataFrame(lines, "release string, place int, line string")
    got = compositions.compositions(spark, df)
    assert "MapInArrow" in _plan(got)
    spark.udtf.register("one_by_one", compositions.Composition)
    want = spark.sql("SELECT c.* FROM one_by_one(TABLE({lines}) PARTITION BY release ORDER BY place) AS c", lines=df)
    key = lambda x: tuple(map(str, x))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() == 5
