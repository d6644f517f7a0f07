"""Identity of a release from the text of its announcement: ordered rules that take spans of the text.

A rule finds its pattern in what the rules before it have left. What it finds is taken: later rules can't use these characters, so a
volume isn't read out of a date, nor a year of an edition out of a price. Every find keeps its place in the text as it was given.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


class Rule(NamedTuple):
    """A kind of find, its pattern, and its value: a template over the pattern's groups (empty ones as 0)."""

    kind: str
    pattern: str
    value: str
    marks: tuple[str, ...] = ()  # no find without one of them in the lower-cased text


_Y, _M, _D = r"(?P<y>(?:19|20)\d{2})", r"(?P<m>1[0-2]|0?[1-9])", r"(?P<d>3[01]|[12]\d|0?[1-9])"
#: Names of special editions in the order in which they are looked for, with the identity that they give.
EDITIONS = {
    "the-luxury": ("the luxury edition", "the luxury"), "luxury": ("luxury edition", "luxury", "ラグジュアリーエディション", "ラグジュアリー"), "the-deluxe": ("the deluxe",), "deluxe": ("deluxe", "デラックス"),
    "exquisite": ("exquisite", "エクスクイジット"),
}
#: Words before a cast, and words that are no names.
CAST_LEADS, NOT_NAMES = ("出演女優", "出演", "女優", "キャスト", "cast", "featuring", "feat."), ("発売", "販売", "予約", "box", "pack", "カード", "card", "円", "税込", "税別", "枚")
#: Dates come first, as they hold figures that others would take; then prices, which are only taken; then editions before volumes, as an
#: edition's announcement may name older volumes.
RULES = (
    Rule("date", rf"{_Y}\s*年\s*{_M}\s*月\s*{_D}\s*日", "{y:04d}-{m:02d}-{d:02d}", ("日",)),
    Rule("date", rf"(?<!\d){_Y}\s*([/.-])\s*{_M}\s*\2\s*{_D}(?!\d)", "{y:04d}-{m:02d}-{d:02d}", ("/", ".", "-")),
    Rule("date", rf"{_Y}\s*年\s*{_M}\s*月", "{y:04d}-{m:02d}", ("月",)),
    Rule("price", r"[¥￥]\s*\d[\d,]*|(?<!\d)\d[\d,]*\s*円", "", ("¥", "￥", "円")),
    Rule("anniversary", r"(?<!\d)(?P<n>\d{1,2})(?:st|nd|rd|th)?\s*ann(?:i)?versary\b|(?<!\d)(?P<o>\d{1,2})\s*周年", "anniversary:{n}", ("versary", "周年")),
    *(Rule("edition", "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + r"(?:\s+edition)?", key, tuple(w.split()[1] if w.startswith("the ") else w.split()[0] for w in words)) for key, words in EDITIONS.items()),
    Rule("plus", r"\bplus\s*(?:[#h*]\s*)?0*(?P<n>\d{1,3})\b", "plus:{n}", ("plus",)),
    Rule("volume", r"\bvol(?:ume)?[.]?\s*0*(?P<n>\d{1,3})\b", "volume:{n}", ("vol",)),
    Rule("volume", r"第\s*0*(?P<n>\d{1,3})\s*弾", "volume:{n}", ("弾",)),
    Rule("cast", rf"(?:{'|'.join(map(re.escape, CAST_LEADS))})\s*[:：]?\s*(?P<names>[^\n|｜。!！]{{2,200}})", "", CAST_LEADS),
    Rule("year", r"(?<!\d)(?P<y>20\d{2})(?!\d)", "{y:04d}", ("20",)),
)
_COMPILED = [(r, re.compile(r.pattern)) for r in RULES]  # for lower-cased texts
FINDS = "array<struct<kind:string,start:int,end:int,value:string>>"
_FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())]))


#: Full-width letters, figures and signs, and the wide space, as narrow ones: each keeps its place.
_NARROW = {c: unicodedata.normalize("NFKC", chr(c)) for c in (0x3000, *range(0xFF01, 0xFF61))}


_WIDE = re.compile("[\u3000\uff01-\uff60]")
#: Letters outside ASCII that count as i, k and s whatever the case; lower-casing keeps all other places.
_FOLDED, _ODD = str.maketrans("İıKſ", "iiks"), re.compile("[İıKſ]")
_SPLIT, _NO_NAME, _GAPS = re.compile(r"([、,，＆&/・]|\s{2,})"), re.compile(r"[\W\d]+"), re.compile(r"(?<=\d)[ \t]+(?=\d\b)")


def narrowed(text: str) -> str:
    return text.translate(_NARROW) if _WIDE.search(text) else text


@lru_cache(1 << 14)
def names_in(text: str) -> list[tuple[int, int, str]]:
    """The names of a cast list, with their places; words of sale end it. Casts come again and again."""
    out, at = [], 0
    for part in _SPLIT.split(text):
        name = part.strip()
        if any(w in name.lower() for w in NOT_NAMES):
            break
        if 2 <= len(name) <= 30 and not _NO_NAME.fullmatch(name):
            begin = at + part.index(name)
            out.append((begin, begin + len(name), name))
        at += len(part)
    return out


def release_finds(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of what the rules find, in the order of their places. A rule is looked at only where one of its marks
    is left in the text."""
    left, out = narrowed(text), []
    left = _GAPS.sub(lambda m: "\0" * len(m[0]), left)  # figures that layout has split: VOL. 2 8
    low = (left.translate(_FOLDED) if _ODD.search(left) else left).lower()
    for rule, pattern in _COMPILED:
        for mark in rule.marks:
            if mark in low:
                break
        else:
            continue
        spans = []
        for start, end, groups in _over_gaps(pattern, low):
            spans.append((start, end))
            if rule.kind == "cast":
                begin = groups["names"][0]
                out += [("cast", begin + a, begin + b, name) for a, b, name in names_in(left[begin:end].replace("\0", " "))]
            elif rule.kind != "price":
                n = {k: int(v[1]) for k, v in groups.items() if v[1].isdigit()}
                out.append((rule.kind, start, end, rule.value.format(**{"n": n.get("o", 0), **n}) if "{" in rule.value else rule.value))
        for start, end in spans:
            gone = "\n" * (end - start)
            left, low = left[:start] + gone + left[end:], low[:start] + gone + low[end:]
    return sorted(out, key=lambda x: (x[1], x[2]))


def _over_gaps(pattern: re.Pattern, text: str):
    """Finds in a text whose split figures are joined, by their places in the text with the gaps."""
    if "\0" not in text:
        for m in pattern.finditer(text):
            yield *m.span(), {k: (m.start(k), v) for k, v in m.groupdict().items() if v is not None}
        return
    kept = [i for i, c in enumerate(text) if c != "\0"]
    kept.append(len(text))
    place = lambda span: (kept[span[0]], kept[span[1] - 1] + 1) if span[1] > span[0] else (kept[span[0]],) * 2
    for m in pattern.finditer(text.replace("\0", "")):
        groups = {k: (place(m.span(k))[0], v) for k, v in m.groupdict().items() if v is not None}
        yield *place(m.span()), groups


@F.arrow_udf(_FOUND)
def _finds(text: pa.Array) -> pa.Array:
    """Finds in columns: no row object is made for a find."""
    offsets, kinds, starts, ends, values = [0], [], [], [], []
    for t in text.to_pylist():
        for kind, start, end, value in release_finds(t) if t is not None else ():
            kinds.append(kind)
            starts.append(start)
            ends.append(end)
            values.append(value)
        offsets.append(len(kinds))
    own = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())], names=["kind", "start", "end", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own, mask=text.is_null() if text.null_count else None)


def release_identities(texts: DataFrame, text: str = "text") -> DataFrame:
    """`texts` with identity, volume, edition, released and people of the release that each text announces, and `finds` with their places.

    An anniversary or a special edition, with the first year that is left, comes before a numbered series, `plus` before volumes.
    The first date counts. Nothing found: nulls and no people.
    """
    df = texts.withColumn("finds", F.coalesce(_finds(F.col(text)), F.expr(f"cast(array() as {FINDS})")))
    first = lambda *kinds: F.get(F.filter("finds", lambda x: x["kind"].isin(*kinds)), F.lit(0))["value"]
    year = F.coalesce(first("year"), F.substring(first("date"), 1, 4), F.lit("unknown"))
    special: Column = F.coalesce(first("anniversary"), first("edition"))
    numbered = F.coalesce(first("plus"), first("volume"))
    return df.select(
        *texts.columns, F.coalesce(F.concat_ws(":", F.when(special.isNotNull(), special), F.when(special.isNotNull(), year)).try_cast("string"), F.lit("")).alias("_special"), numbered.alias("_numbered"),
        first("edition").alias("edition"), first("date").alias("released"), F.transform(F.filter("finds", lambda x: x["kind"] == "cast"), lambda x: x["value"]).alias("people"), "finds",
    ).select(
        *texts.columns, F.when(F.col("_special") != "", F.col("_special")).otherwise(F.col("_numbered")).alias("identity"),
        F.when(F.col("_special") == "", F.element_at(F.split("_numbered", ":"), -1)).try_cast("int").alias("volume"), "edition", "released", "people", "finds",
    )
