"""Rules about titles, names, offers and addresses that need the words around a find, as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def narrow(text: Column) -> Column:
    """Full-width ASCII as ASCII, the ideographic space as a space: the part of compatibility form that titles need."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("[\uff01-\uff5e\u3000]"), F.translate(t, _WIDE, _NARROW)).otherwise(t)


def key(text: Column) -> Column:
    """Letters and digits of the narrow, lower-cased text."""
    return F.regexp_replace(F.lower(narrow(text)), r"[^\p{L}\p{N}]+", "")


def any_of(words: tuple[str, ...]) -> str:
    """Pattern of any of the words; Latin ones stand alone, a space in them may be any or none."""

    def one(w: str) -> str:
        body = r"\s*".join(re.escape(x) for x in w.split())
        return rf"\b{body}\b" if w.isascii() else body

    return "(?i)(?:" + "|".join(map(one, words)) + ")"


#: Words that say what a title sells; (code, words, whether a photobook word in the title outweighs them).
SIGNALS = ("photobook", "photo book", "photography book", "写真集", "フォトブック", "寫真集", "寫真書", "攝影集", "摄影集", "照片集", "影像集")
#: A photobook said outright, which outweighs some rules.
STRONG_SIGNAL = (
    r"(?i)\bphoto\s*book\b|\bphotography\s*book\b|\bphoto(?:graphic)?\s+(?:essay|monograph|album)\b|写真集|フォトブック|寫真集|寫真書|數位寫真|数字写真|數字寫真|攝影集|摄影集|攝影書|摄影书|照片集|"
    r"写真本|写真帖|寫真帖|写真画集|攝影畫冊|摄影画册|攝影作品集|摄影作品集|影像集|影像作品集"
)
#: What a title sells, in order: (code, pattern, whether a photobook said outright outweighs it). Rules that name single
#: works and people are not shipped; a table with them can be given instead.
TITLE_RULES = (
    ("nonhuman_subject", r"リカちゃん人形", False),
    ("nonbook_product", r"生写真.*ブロマイド.*セット.*ポストカード|写真集.*映画パンフレット", False),
    ("magazine_only", r"写真集系雑誌", False),
    ("nonbook_product", r"テレホンカード.*度数", False),
    ("magazine_only", r"(?i)表紙.*洋書|GRAVURE\s*MAGAZINE", False),
    ("magazine_or_supplement", r"漫画アクション|ヤングジャンプ.*[0-9]+号", False),
    ("magazine_only", r"旧雑誌|PAPER.*表紙", False),
    ("synthetic_subject", r"(?i)AIポスター", False),
    ("disc_only", r"(?i)ROM写真集", False),
    ("nonbook_product", r"ブロマイド$", False),
    ("reference_book", r"写真集ガイド", False),
    ("magazine_only", r"表紙.*インタビュー", False),
    ("disc_only", r"(?i)雑誌付録DVD|写真集SE\s*DVD", False),
    ("disc_only", r"(?i)^DVD\s*写真集|DVD写真集\[", False),
    ("disc_only", r"(?i)\[中古[^\]]*DVD\]|写真集.*メイキングDVD.*枚セット", False),
    ("nonbook_product", r"L判写真\s*[0-9]+枚", False),
    ("nonbook_product", r"ボールマーカー", False),
    ("magazine_or_supplement", r"ミニ写真集付き.*漫画アクション", False),
    ("nonbook_product", r"(?i)アート\s*ポスター|\[(?:中古(?:\s*セル版)?|新品\s*未開封)\s*DVD\]|カレンダーブック|フォトCD|Photo\s*CD|額入り|舞台.*パンフレット|振袖カタログ", False),
    ("magazine_only", r"(?i)[0-9]{4}年\s*[0-9]{1,2}月(?:[0-9]{1,2}日)?号|週刊現代|週刊プレイボーイ|TVガイド\s*Stage\s*Stars|EX大衆|ヤングチャンピオン.*袋とじ|臨時増刊", False),
    ("magazine_only", r"グラビアチャンピオン", False),
    ("magazine_or_supplement", r"(?i)写真集クオリティ|グラビアザテレビジョン|特別付録.*MINIブック", False),
    ("disc_only", r"(?i)(?:CD|BD|Blu[ -]?ray|ブルーレイ)\s*写真集|^アイドルDVD", False),
    ("disc_only", r"(?i)DVD|Blu[ -]?ray|ブルーレイ", True),
    ("magazine_only", r"(?i)増刊|FRIDAY\s*GOLD", True),
    ("synthetic_subject", r"(?i)AI[\s・_-]*(?:アート|美女|生成|グラビア)|生成AI|AI-generated", False),
    ("download_resale", r"写真データ|画像データ|ダウンロード販売", False),
    ("junior_gravure", r"(?i)(?:ジュニア|Jr\.).*(?:グラビア|水着)|(?:グラビア|水着).*(?:ジュニア|Jr\.)", False),
    ("magazine_only", r"[0-9]{4}年[0-9]{1,2}月号|特集号|熱烈投稿|雑誌", True),
    ("illustrated_book", r"(?i)插畫|插画|イラスト|illustrat(?:ed|ion)", False),
    ("calendar_only", r"(?i)月曆|月历|桌曆|桌历|日曆|日历|掛曆|挂历|年曆|年历|カレンダー|\bcalendar\b", True),
)
#: What a title must hold for any rule of TITLE_RULES to fit: a kana or Han letter, or one of these words.
TITLE_MARKS = r"(?i)[\u3000-\u9fff]|dvd|blu|gravure|friday|photo|generated|illustrat|calendar"
#: Brands of magazines under which single books are sold too, what says that a title is such a book, and what says that
#: it comes with a magazine.
MAGAZINE_BRANDS, MAGAZINE_CODES = r"週刊現代|週刊プレイボーイ|EX大衆|漫画アクション", ("magazine_only", "magazine_or_supplement")
DIGITAL_BOOK = r"デジタル写真集|グラビアン魂.*写真集|写真集.*グラビアン魂"
WITH_MAGAZINE = r"(?:デジタル|ミニ)写真集(?:付き|付属)|(?:付録|特典).{0,12}写真集|雑誌"
#: Weaker signals of a photobook, things that are none, and phrases about extras that come with one.
WEAK_SIGNAL = STRONG_SIGNAL + r"|(?<!生)写真|寫真|相冊|相簿|画册|畫冊"
NOT_BOOKS = (
    r"(?i)\b(?:trading\s*card|photo\s*card|photocard|figure|figurine|doll|plush|acrylic|keychain|merch|goods|custom\s*album|empty\s*album|photo\s*book\s*printing|printing\s*service|voucher)\b|"
    r"トレカ|トレーディングカード|フォトカード|生写真カード|チェキ|フィギュア|ぬいぐるみ|アクリル|グッズ|周邊|周辺|寫真卡|照片卡|收藏卡|交易卡|相簿內頁|空白相簿|空白相冊|自製相冊|定制相冊|立牌|印刷服務|印刷服务|兌換碼|兑换码"
)
SCALE_MODELS = r"(?i)\b(?:(?:car|aircraft|vehicle|scale|plastic)\s+model|model\s+(?:kit|train|number))\b|モデルカー|模型玩具|模型套件|模型車|模型车"
CARDS = r"(?i)\b(?:postcard|poster|calendar|sticker|card|photo\s*card)\b|ポストカード|ポスター|カレンダー|カード|海報|日曆|明信片|卡片"
ALBUMS, ARTBOOKS, PHOTOGRAPHY = r"相冊|相簿|相册", r"(?i)\bart\s*book\b|artbook|画册|畫冊", r"(?i)写真|寫真|摄影|攝影|photo"
_EXTRA = r"(?:postcard|poster|calendar|sticker|card|photo\s*card|トレカ|トレーディングカード|寫真卡|照片卡|收藏卡|交易卡|ポストカード|ポスター|カレンダー|カード|海報|日曆|明信片|卡片)"
BONUS = rf"(?i)(?:bonus|with|includes?|including|特典|付録|附贈|附赠|贈品|赠品|付き|付属|附送|含).{{0,50}}{_EXTRA}|{_EXTRA}.{{0,30}}(?:bonus|特典|付き|付属|附贈|附赠|贈品|赠品)"
#: Reasons by which a reviewer may exclude a title.
EXCLUSIONS = (
    "calendar_only", "illustrated_book", "disc_only", "magazine_only", "magazine_or_supplement", "junior_gravure", "artist_monograph", "synthetic_subject",
    "download_resale", "free_preview", "nonbook_product", "subject_publication_age_unverified", "nonhuman_subject", "reference_book", "incorrect_model_association",
)


def title_exclusion(title: Column, rules=TITLE_RULES) -> Column:
    """Code of the first rule that fits a title, or null. `rules` may be any table of that shape. Most titles
    hold nothing of TITLE_MARKS, so one pattern is tried on them and not all."""
    text = narrow(title)
    may = text.rlike(TITLE_MARKS) if rules is TITLE_RULES else F.lit(True)
    out, signal = F.when(~may, None), text.rlike(STRONG_SIGNAL)
    for code, pattern, outweighed in rules:
        hit = text.rlike(pattern)
        out = out.when(hit & ~signal if outweighed else hit, code)
    return out


def digital_title_exclusion(title: Column, rules=TITLE_RULES) -> Column:
    """The same for digital books. One that is sold under a magazine's brand and says that it is a book of its own is judged again
    without the brand, so that other reasons still exclude it."""
    text, reason = narrow(title), title_exclusion(title, rules)
    own = reason.isin(*MAGAZINE_CODES) & text.rlike(DIGITAL_BOOK) & ~text.rlike(WITH_MAGAZINE)
    return F.when(own, title_exclusion(F.regexp_replace(text, MAGAZINE_BRANDS, ""), rules)).otherwise(reason)


#: A neutral sample of a rule table of a store: signs, menus, shouts, calendars and licences.
STORE_RULES = (
    ("symbols", r"[#$%&*]{3,}", False),
    ("menu", r"\|.*\|.*\|", False),
    ("shouting", r"!!.*!!", False),
    ("calendar", r"(?i)calendar|kalender|calendrier|calendario", False),
    ("licence", r"(?i)licensed under", False),
)


def brand_exclusion(title: Column, brand: Column, rules=STORE_RULES) -> Column:
    """The rules on the title without its store's brand."""
    return title_exclusion(F.trim(F.replace(title, brand, F.lit(""))), rules)


def looks_like_photobook(title: Column) -> Column:
    """A photobook is said, and once phrases about extras are taken out, nothing says that it is something else."""
    text = narrow(F.coalesce(title, F.lit("")))
    bare = F.regexp_replace(text, BONUS, " ")
    other = bare.rlike(NOT_BOOKS) | bare.rlike(SCALE_MODELS) | ((bare.rlike(CARDS) | bare.rlike(ALBUMS)) & ~bare.rlike(STRONG_SIGNAL)) | (bare.rlike(ARTBOOKS) & ~bare.rlike(PHOTOGRAPHY))
    return text.rlike(WEAK_SIGNAL) & ~other


#: Words of electronic and of printed editions, and of extras that come with a printed one.
DIGITAL = ("ebook", "e-book", "digital", "pdf", "epub", "電子書", "电子书", "電子版", "电子版", "デジタル写真集", "電子写真集")
PRINTED = ("paperback", "hardcover", "printed", "physical", "紙本", "纸本", "實體", "实体", "印刷", "ハードカバー", "ソフトカバー", "書籍")
EXTRAS = ("bonus", "qr", "code", "特典", "付録", "附贈", "附赠", "贈品", "赠品")
REACH = 100


def inferred_format(text: Column, kind: Column) -> Column:
    """physical or digital: an electronic word decides, unless it stands within REACH characters of an extra's word in a
    text that names a printed edition; without any, a digital store's offers are digital."""
    found = F.regexp_instr(text, F.lit(any_of(DIGITAL)))
    size = F.length(F.regexp_substr(text, F.lit(any_of(DIGITAL))))
    near = F.substr(text, F.greatest(found - REACH, F.lit(1)), F.least(found - 1, F.lit(REACH)) + size + REACH)
    printed = text.rlike(any_of(PRINTED))
    extra = printed & near.rlike(any_of(EXTRAS))
    return F.when(found > 0, F.when(extra, "physical").otherwise("digital")).when((kind == "digital_store") & ~printed, "digital").otherwise("physical")


def subject_matches(title: Column, names: Column) -> Column:
    """Whether one of the names stands before the title's first photobook word; names after it are search bait."""
    before = key(F.element_at(F.split(title, any_of(SIGNALS), 2), 1))
    keys = F.filter(F.transform(names, key), lambda k: k != "")
    return (F.size(names) == 0) | F.exists(keys, lambda k: F.contains(before, k))


def search_names(primary: Column, aliases: Column) -> Column:
    """Names to search a person by: the primary ones, then aliases that are no part of a primary name and are a full name
    (two Latin words, or three letters); each key once, in order."""
    named = lambda names: F.filter(F.transform(names, lambda n: F.struct(F.trim(F.coalesce(n, F.lit(""))).alias("n"), key(F.coalesce(n, F.lit(""))).alias("k"))), lambda x: x["k"] != "")

    def useful(main: Column, x: Column) -> Column:
        part = F.exists(main, lambda m: F.contains(m["k"], x["k"]) & (F.length(x["k"]) < F.length(m["k"])))
        return ~part & ((F.length(x["k"]) >= 3) | (F.size(F.regexp_extract_all(x["n"], F.lit("[A-Za-z0-9]+"), F.lit(0))) >= 2))

    # Keys are made once: what a lambda is given is a value, what it refers to outside is computed for each element again.
    whole = _bound(F.struct(named(primary).alias("m"), named(aliases).alias("a")), lambda s: F.concat(s["m"], F.filter(s["a"], lambda x: useful(s["m"], x))))
    once = _bound(F.struct(whole.alias("w"), F.transform(whole, lambda x: x["k"]).alias("k")), lambda s: F.filter(s["w"], lambda x, i: F.array_position(s["k"], x["k"]) == i + 1))
    return F.transform(once, lambda x: x["n"])


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


GROUP = r"\s*(?:\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】)\s*$"


def without_groups(title: Column, depth: int = 4) -> Column:
    """The title without bracketed groups at its end, `depth` of them at most."""
    out = F.trim(title)
    for _ in range(depth):
        out = F.regexp_replace(out, GROUP, "")
    return out


def label_fits(label: Column, title: Column) -> Column:
    """Whether a picture's label is a title's: one begins with the other and makes up 55 in 100 of it; keys of fewer than
    six characters must be equal."""
    a, b = key(without_groups(label)), key(without_groups(title))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    part = F.startswith(long, short) & (F.length(short) * 100 >= F.length(long) * 55) & (short != "")
    return F.when(F.length(b) < 6, (a == b) & (a != "")).otherwise(part)


#: File names of pictures that stores show instead of a cover.
PLACEHOLDERS = ("restricted.jpg", "noimage.jpg", "now_printing.jpg")


def cover_url(candidates: Column) -> Column:
    """The first address that is https and no placeholder or masked picture, or null."""
    name = lambda u: F.lower(F.regexp_extract(u, r"([^/?#]*)(?:[?#].*)?$", 1))
    good = lambda u: u.rlike(r"^https://[^/\s]+/") & ~name(u).isin(*PLACEHOLDERS) & ~name(u).rlike(r"_mask\.[a-z]+$")
    return F.get(F.filter(F.array_compact(candidates), good), F.lit(0))


#: (store, hosts, path pattern with the item's id as its group, parameter that holds it instead, address of the item).
#: Stores are named by what they do: the table is a parameter, and this one is a sample of its shapes.
STORES = (
    ("numbered_book", ("books.example.com",), r"^/(?:[a-z]{2}/)?book/(?:[^/]+/)?id([0-9]+)/?$", None, "https://books.example.com/book/id{}"),
    ("product_page", ("www.example.org", "m.example.org"), r"^/products?/([0-9A-Za-z-]+)(?:\.html)?/?$", "pid", "https://www.example.org/product/{}"),
    ("auction", ("auctions.example.net",), r"^/auction/([a-z][0-9]+)/?$", None, "https://auctions.example.net/auction/{}"),
    ("language_page", ("example.com", "example.net", "example.org"), r"^/[a-z]{2}/([0-9]+)(?:[/.].*)?$", None, None),
    ("item_query", ("item.example.net",), None, "id", "https://item.example.net/item?id={}"),
)


def store_item(url: Column, stores=STORES) -> Column:
    """struct(store, id, address) of a result page's address, by the first store whose host and path fit; null for others.

    A host fits itself and its subdomains. The address is the item's own one, without what searches and trackers add.
    """
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    out = F.lit(None).cast("struct<store:string,id:string,address:string>")
    for name, hosts, pattern, parameter, address in reversed(stores):
        fits = F.lit(False)
        for h in hosts:
            fits = fits | (host == h) | F.endswith(host, F.lit("." + h))
        ids = [F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))] if pattern else []
        ids += [F.nullif(F.regexp_extract(url, rf"[?&]{parameter}=([0-9A-Za-z_-]+)", 1), F.lit(""))] if parameter else []
        item = F.coalesce(*ids)
        own = F.concat(F.lit(address.split("{}")[0]), item, F.lit(address.split("{}")[1])) if address else F.concat(F.lit("https://"), host, path)
        out = F.when(fits & item.isNotNull(), F.struct(F.lit(name).alias("store"), item.alias("id"), own.alias("address"))).otherwise(out)
    return out


def moment(text: Column) -> Column:
    """UTC moment of a source's date: epoch seconds or milliseconds, ISO, numeric with / or ., or with 年月日 signs; else null.

    Moments without a zone are UTC, days are midnight.
    """
    t = F.trim(narrow(text))
    epoch = F.when(t.rlike("^[0-9]{13}$"), F.timestamp_millis(t.try_cast("bigint"))).when(t.rlike("^[0-9]{10}$"), F.timestamp_seconds(t.try_cast("bigint")))
    part = lambda i: F.regexp_extract(t, r"^([0-9]{4})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})", i)
    clock = F.regexp_extract(t, r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)", 1)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    plain = F.when(part(1) != "", F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").when(F.length(clock) <= 5, F.concat(F.lpad(clock, 5, "0"), F.lit(":00"))).otherwise(F.lpad(clock, 8, "0"))))
    return F.coalesce(epoch, plain.try_cast("timestamp"))


#: Words before a sale's amount and before amounts that are none.
SOLD_LABELS = ("落札価格", "落札額", "sold for", "winning bid", "final price")
OPEN_LABELS = ("現在価格", "現在", "current bid", "current price")
BUY_LABELS = ("即決価格", "即決", "buy it now", "buy now")


def labelled_amount(text: Column, labels: tuple[str, ...]) -> Column:
    """The whole number after one of the labels, or null; 最低落札 (a reserve) is no sale."""
    text = narrow(text)
    said = F.lit(False)
    for label in labels:
        said = said | F.contains(F.lower(text), F.lit(label.lower().split()[0]))
    hit = F.regexp_extract(F.when(said, text).otherwise(""), r"(?<!最低)" + any_of(labels).replace("(?i)", "(?i:") + r")\s*[:]?\s*[¥$]?\s*([0-9][0-9,]*)", 1)
    return F.replace(hit, F.lit(","), F.lit("")).try_cast("bigint")


def sale_price_type(platform: Column, text: Column, title: Column) -> Column:
    """auction_hammer where the platform only auctions, or where a mixed one's text, its title aside, speaks of bids."""
    bare = F.replace(F.lower(text), F.lower(title), F.lit(" "))
    bids = bare.rlike(any_of(("auction", "bid", "bids", "入札")))
    return F.when(platform == "auction", "auction_hammer").when((platform == "marketplace") & bids, "auction_hammer").otherwise("fixed_price_sold")


#: The grant and the fields that each operation of a source needs.
_PRICES = ("title", "url", "format", "price", "currency", "availability", "observed_at")
OPERATIONS = {
    "catalog_discovery": ("bibliography", ("title", "url", "format")),
    "active_discovery": ("current_prices", _PRICES),
    "listing_detail": ("current_prices", _PRICES),
    "listing_reconcile": ("current_prices", _PRICES),
    "sold_discovery": ("used_prices", ("title", "url", "format", "price", "currency", "condition", "seller_location", "shipping", "availability", "observed_at")),
}


def operation_needs(operation: Column) -> Column:
    """struct(scope, fields), null for unknown operations."""
    op, out = F.lower(F.trim(operation)), F.lit(None).cast("struct<scope:string,fields:array<string>>")
    for name, (scope, fields) in OPERATIONS.items():
        out = F.when(op == name, F.struct(F.lit(scope).alias("scope"), F.array(*map(F.lit, fields)).alias("fields"))).otherwise(out)
    return out


def media_problem(scope: Column, evidence: Column, basis: Column, reviewed: Column, original: Column, storage: Column, kind: Column) -> Column:
    """Why a picture's provenance isn't enough, or null: known scope and kind, https addresses, and for every reviewed scope
    evidence, a basis and a date; a picture that is only displayed is the original one."""
    https = lambda u: F.coalesce(u.rlike(r"^https://[^/\s]+/\S*$"), F.lit(False))
    scope = F.coalesce(F.nullif(F.trim(scope), F.lit("")), F.lit("unreviewed"))
    return (
        F.when(~F.coalesce(kind.rlike("^(publisher_cover|publisher_sample_[0-9]{3}|listing_image(_[0-9]{3})?)$"), F.lit(False)), "kind")
        .when(~https(original) | ~https(storage), "address").when(~scope.isin("unreviewed", "remote_display", "display_and_copy", "revoked"), "scope")
        .when(scope == "unreviewed", None).when(~https(evidence), "evidence").when(F.coalesce(F.trim(basis), F.lit("")) == "", "basis").when(reviewed.isNull(), "review")
        .when((scope == "remote_display") & (original != storage), "copied")
    )


def offer_dates(fmt: Column, store_date: Column, release_date: Column, original_date: Column, offer_url: Column, original_url: Column) -> Column:
    """struct(store_date, original_date, problem): a digital offer's date is its store's; the original publication's date
    needs a source of its own, on another host than the store's."""
    host = lambda u: F.nullif(F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^https?://([^/?#:]+)", 1)), F.lit(""))
    digital = fmt == "digital"
    own = digital & (host(original_url).isNull() | host(original_url).eqNullSafe(host(offer_url)))
    return F.struct(
        F.when(digital, F.coalesce(store_date, release_date)).otherwise(store_date).alias("store_date"), F.when(~own, original_date).alias("original_date"),
        F.when(own, "original_unknown").alias("problem"),
    )


def product_node(html: Column) -> Column:
    """struct(type, name, isbn, price, currency) of the one Book or Product node of a page's structured data.

    A page that describes several different ones (a list, recommendations) describes none. A script that is no JSON is
    skipped.
    """
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    one = "struct<`@type`:string,name:string,isbn:string,offers:struct<price:string,priceCurrency:string>>"
    lists = F.transform(scripts, lambda x: F.when(F.ltrim(x).startswith("["), F.from_json(x, f"array<{one}>")).otherwise(F.array(F.from_json(x, one))))
    nodes = F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda n: n["@type"].isin("Book", "Product"))
    flat = F.transform(nodes, lambda n: F.struct(n["@type"].alias("type"), n["name"].alias("name"), n["isbn"].alias("isbn"), n["offers"]["price"].alias("price"), n["offers"]["priceCurrency"].alias("currency")))
    different = F.array_distinct(flat)
    return F.when(F.size(different) == 1, F.get(different, F.lit(0)))


def page_cursor(payload: Column) -> Column:
    """struct(token, more) of a JSON answer: the next page's token under any of the names that sources use for it."""
    token = F.coalesce(*(F.nullif(F.get_json_object(payload, f"$.{path}"), F.lit("")) for path in ("nextPageToken", "meta.nextPageToken", "pagination.next", "cursor")))
    return F.struct(token.alias("token"), (token.isNotNull() & ~F.coalesce(F.get_json_object(payload, "$.hasMore") == "false", F.lit(False))).alias("more"))


def encoded_cursor(sort: str, value: Column, key: Column) -> Column:
    """A page's end as one opaque text, bound to the order in which the pages were made."""
    return F.base64(F.to_json(F.struct(F.lit(sort).alias("s"), value.cast("string").alias("v"), key.cast("string").alias("k"))).cast("binary"))


def decoded_cursor(cursor: Column, sort: str) -> Column:
    """struct(v, k) of a cursor of this order; null for one of another order, or none."""
    c = F.from_json(F.try_to_binary(cursor, F.lit("base64")).cast("string"), "s string, v string, k string")
    return F.when(c["s"] == sort, F.struct(c["v"].alias("v"), c["k"].alias("k")))


#: How titles number a volume, with the number in place of #.
VOLUMES = ("vol.#", "volume #", "第#巻", "#巻")
VOLUME = r"(?i)(?:\bvol(?:ume)?\.?\s*|第)([0-9]+)|([0-9]+)\s*巻"


def volume(title: Column) -> Column:
    """The volume number that a title states, or null."""
    t = narrow(title)
    return F.coalesce(F.nullif(F.regexp_extract(t, VOLUME, 1), F.lit("")), F.nullif(F.regexp_extract(t, VOLUME, 2), F.lit(""))).try_cast("int")


def title_answers(query: Column, title: Column) -> Column:
    """Whether a title answers a search: it has every quoted phrase as it stands, every other word somewhere, and, where both
    state a volume, the same one."""
    q, t = F.lower(narrow(query)), F.lower(narrow(title))
    phrases = F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(q, '"[^"]*"', " "), VOLUME, " ")
    words = F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.forall(phrases, lambda p: F.contains(t, p)) & F.forall(words, lambda w: F.contains(key(t), w)) & F.coalesce(volume(q) == volume(t), F.lit(True))


#: What sellers put around a title.
NOISE = ("送料無料", "即決", "美品", "新品", "中古", "free shipping", "brand new", "used")


def cleaned_title(title: Column) -> Column:
    """A listing's title without sellers' words, marks and item numbers, single-spaced."""
    out = F.regexp_replace(narrow(title), any_of(NOISE), " ")
    out = F.regexp_replace(out, r"[★☆◆◇■□●○!]+|(?i:\bitem\s*#?[0-9]+\b)", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
