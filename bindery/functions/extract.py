"""Prices, states and names read out of page text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from bindery.functions.offers import minor_units

AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
#: What stands before or after an amount in each currency, in the order in which they are looked for.
MARKS = (
    ("JPY", ("JPY", "¥", "￥"), ("円", "JPY")),
    ("TWD", ("NT$", "TWD"), ()),
    ("CNY", (), ("元", "CNY", "RMB")),
    ("MYR", ("RM", "MYR"), ()),
    ("USD", ("US$", "USD", "$"), ()),
)
#: Words that announce a price.
PRICE_WORDS = ("price", "amount", "価格", "售價", "售价", "金額")


def _beside(before: tuple[str, ...], after: tuple[str, ...]) -> list[str]:
    """Patterns of an amount with one of these marks before it, and with one after it."""
    either = lambda words: "|".join(re.escape(w) for w in words)
    out = [rf"(?i)(?:{either(before)})\s*{AMOUNT}"] if before else []
    return out + ([rf"(?i){AMOUNT}\s*(?:{either(after)})"] if after else [])


CURRENCIES = tuple((pattern, code) for code, before, after in MARKS for pattern in _beside(before, after))
LABELLED = rf"(?i)(?:{'|'.join(PRICE_WORDS)})\s*[:：]?\s*{AMOUNT}"
#: Currencies of regions, and what ambiguous signs mean there.
REGION_CURRENCY = {"JP": "JPY", "TW": "TWD", "CN": "CNY", "MY": "MYR", "MLS": "MYR"}


def region_currency(region: Column) -> Column:
    out = F.lit("")
    for r, c in REGION_CURRENCY.items():
        out = F.when(F.upper(region) == r, c).otherwise(out)
    return out


def parsed_price(text: Column, structured: Column, structured_currency: Column, region: Column) -> Column:
    """struct(price_minor, currency): structured data first, then signs next to amounts, then a labelled bare amount.

    A bare dollar or yen sign, and the character for yuan, mean the region's own currency where it uses that sign. No
    price is 0.
    """
    home = region_currency(region)

    def local(code: str) -> Column:
        if code == "JPY":
            return F.when(home == "CNY", "CNY").otherwise(code)
        if code == "CNY":
            return F.when(home == "TWD", "TWD").otherwise(code)
        if code == "USD":
            return F.when(home.isin("TWD", "MYR") & ~text.rlike(r"(?i)US\$|USD"), home).otherwise(code)
        return F.lit(code)

    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(18,4)")
    amount, currency = F.lit(None).cast("decimal(18,4)"), home
    bare = number(F.nullif(F.regexp_extract(text, LABELLED, 1), F.lit("")))
    amount = bare
    for pattern, code in reversed(CURRENCIES):
        hit = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        currency = F.when(hit.isNotNull(), local(code)).otherwise(currency)
        amount = F.coalesce(number(hit), amount)
    given = number(F.nullif(F.trim(structured), F.lit("")))
    given = F.when(given >= 0, given)
    currency = F.when(given.isNotNull(), F.coalesce(F.nullif(F.upper(F.trim(structured_currency)), F.lit("")), home)).otherwise(currency)
    amount = F.coalesce(given, amount)
    return F.struct(F.coalesce(minor_units(amount, currency), F.lit(0)).cast("long").alias("price_minor"), currency.alias("currency"))


#: What follows these headings isn't about the selected item.
SECTIONS = r"(?s)(?:商品說明|商品説明|商品の説明|猜你喜歡|您可能喜歡|こちらの商品もおすすめ|Similar items|Seller notes).*$"
ENDED = r"(?i)(sold out|no longer available|out of stock|売り切れ|在庫なし|オークション終了|已結束|已下架|已售完)"
ACTIVE = r"(?i)(add to cart|buy it now|place bid|in stock|カートに入れる|購入手続きへ|入札する|在庫あり|加入購物車|直接購買)"
SOLD = r"(?i)(sold for|winning bid|final price|落札価格|売れました|已成交|交易完成|成交價)"
NOT_SOLD = r"(?i)(no bids|cancelled|入札者なし|落札者なし|取り消|未成交|已取消)"
COUNTERS = r"(?i)([0-9]+\s+(?:items?\s+)?sold\b|(?:已售出?|銷量|銷售)\s*[0-9][0-9,]*)"


def evident_status(text: Column, operation: Column) -> Column:
    """struct(status, evidence): only what the page says about the selected item; sale counters are no evidence."""
    own = F.regexp_replace(F.regexp_replace(text, SECTIONS, ""), COUNTERS, " ")
    hit = lambda p: F.nullif(F.regexp_extract(own, p, 1), F.lit(""))
    looking = operation.isin("active_discovery", "listing_reconcile")
    sold = (operation == "sold_discovery") & hit(SOLD).isNotNull() & ~own.rlike(NOT_SOLD)
    status = F.when(looking & hit(ENDED).isNotNull(), "ended").when(looking & hit(ACTIVE).isNotNull(), "active").when(sold, "completed").otherwise("unknown")
    evidence = F.when(status == "ended", hit(ENDED)).when(status == "active", hit(ACTIVE)).when(status == "completed", hit(SOLD)).otherwise("no evidence")
    return F.struct(status.alias("status"), evidence.alias("evidence"))


HAN, HIRAGANA, KANA = r"[㐀-鿿々]", r"[぀-ゟ]", r"[぀-ヿー]"
#: Particles that may follow a name.
PARTICLES = "のとがをにはもでへや"


def plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text or "").lower().strip()


def short_name(name: str) -> bool:
    """A single Latin word, up to two Han characters, or up to four kana: too little to name a person by itself."""
    n = plain(name)
    if re.search("[a-z]", n):
        return " " not in n
    return bool(re.fullmatch(HAN + "{1,2}", n) or (re.fullmatch(KANA + "{1,4}", n)))


def title_class(title: str, names: list[str]) -> tuple[str, str]:
    """(named | other | weak | absent, proposed longer name) for how a title relates to a person's names.

    A long name names; a short one is someone else's if a family name stands before it or a longer given name goes
    on after it, and weak evidence where it stands alone.
    """
    text = plain(title)
    found = {"weak": "", "other": None}
    weak = False
    for name in filter(None, map(plain, names)):
        left, right = (r"(?<![a-z0-9])" if name[0].isascii() else ""), (r"(?![a-z0-9])" if name[-1].isascii() else "")
        for m in re.finditer(left + re.escape(name) + right, text):
            if not short_name(name):
                return "named", ""
            family = re.search(rf"(?:{HAN}|{HIRAGANA}){{1,4}}$", text[: m.start()]) if not name[0].isascii() else None
            longer = re.match(rf"(?![{PARTICLES}]){HIRAGANA}{{2,4}}", text[m.end() :]) if re.match(HAN, name[-1]) else None
            if family and not family[0][-1] in PARTICLES:
                found["other"] = found["other"] or family[0] + name
            elif longer:
                found["other"] = found["other"] or name + longer[0]
            else:
                weak = True
    if found["other"]:
        return "other", found["other"]
    return ("weak", "") if weak else ("absent", "")


@F.pandas_udf(StructType().add("cls", StringType()).add("proposed", StringType()))
def classify_title(title: pd.Series, names: pd.Series) -> pd.DataFrame:
    """title_class over Arrow batches; `names` is an array column."""
    return pd.DataFrame([title_class(t, list(n) if n is not None else []) for t, n in zip(title, names, strict=True)], columns=["cls", "proposed"])


def register_all(spark) -> None:
    """The table and scalar functions under SQL names."""
    from bindery.functions import compositions, texts

    spark.udtf.register("composition_groups", compositions.Composition)
    spark.udf.register("nfkc_key", texts.nfkc_key)
    spark.udf.register("classify_title", classify_title)
