"""Published compositions of card releases: lines of text to sections, titles and announced counts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Where a composition begins and ends in a page's text, the marks before its groups, and words of major groups.
STARTS = ("商品構成", "<Collect All", "[REGULAR CARDS]")
ENDS = ("プロフィール", "トレーディングカードは、1ボックス", "※種類数", "※パックには", "<JH PLUS", "システム商品コード")
MAJOR_MARKS, BULLETS = ("◆", "★", "["), "◆●■★☆?・-"
MAJOR_WORDS = (
    "regular card", "rare card", "special card", "super rare", "premium rare", "double rare", "triple rare", "masterpiece", "insert card", "premium insert",
    "レギュラーカード", "レアカード", "スーパーレア", "プレミアム",
)
FIRST_SECTION = "Published composition"
#: Designs or cards of one release, at most.
MOST = 5000
#: Ways in which a line states its count, in the order in which they are looked for.
COUNTS = (r"[<＜]\s*(\d{1,4})\s*種\s*[>＞]", r"(\d{1,4})\s*種類", r"(\d{1,4})\s*種(?!類)", r"(\d{1,4})\s*cards?\b")
BARE_COUNT = r"(?:[:：|]\s*|\s)(\d{1,4})\s*$"
TOTALS = (r"<\s*Collect\s+All\s+(\d{1,4})\s+Cards\s*>", r"全\s*(\d{1,4})\s*(?:類|種類)", r"(\d{1,4})\s*種類\s*予定")
#: A code on a card; a number said to be one, which counts in rows without codes; words of rows that are none.
CODE = r"(?<![A-Za-z0-9])((?:[A-Z]{1,8}[- ]?[0-9]{1,4}|#\s*[0-9]{1,4}))(?![A-Za-z0-9])"
NUMBER = r"(?i)(?:#|(?:no\.?|card\s*(?:no\.?|number)?)[\s:.-]*)\s*([0-9]{1,3})(?![A-Za-z0-9])"
OTHER_ROWS = ("price", "yen", "release", "volume", "vol", "date", "202", "copyright")
YEARS, NOT_CODES = ("2024", "2025", "2026"), ("VOL", "VOLUME", "PAGE", "ITEM", "NO", "CARD")
RARITIES = ("signed", "autograph", "rare", "special", "parallel", "regular", "base")
COMPOSITION = "release string, sequence int, code string, section string, title string, announced int, description string"


_COUNTS, _BARE = [re.compile(way, re.I) for way in COUNTS], re.compile(BARE_COUNT)
_HEADING, _WHOLE = re.compile(r"\[([^\]]+cards?)\]", re.I), re.compile(r"商品構成|Collect All|全\s*\d+\s*(?:類|種類)", re.I)
_RUN, _CLOSING = re.compile(r"\[(?:Limited\s+to|#'?d\s+to)[^\]]+\]", re.I), re.compile(r"[|:：\s<＜\[(]+$")


def stated_count(line: str) -> tuple[int, int] | None:
    """The count that a line states, and where its title ends."""
    cards, kinds = "card" in line.lower(), "種" in line
    for i, way in enumerate(_COUNTS):
        if (cards if i == 3 else kinds) and (m := way.search(line)):
            return int(m[1]), m.start()
    m = _BARE.search(line) if cards or "カード" in line else None
    return (int(m[1]), m.start()) if m else None


def group_title(text: str) -> str:
    """A group's title without its bullet, print run and closing marks."""
    bare = text.lstrip(BULLETS + " \t")
    bare = _RUN.sub("", bare) if "[" in bare else bare
    return " ".join(_CLOSING.sub("", bare).split())


def plain(text: str) -> str:
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().split())


class Sections:
    """The lines of one release in their order: a row for each group with a count, numbered, with the section that the lines before it
    opened. A group that was stated before in its section is left out."""

    def __init__(self):
        self.section, self.seen, self.n = FIRST_SECTION, set(), 0

    def group(self, line: str | None) -> tuple | None:
        """(sequence, code, section, title, announced, description) of the group that a line states, or null."""
        line = " ".join((line or "").split())
        heading = _HEADING.match(line) if line.startswith("[") else None
        stated = stated_count(line)
        if heading and stated is None:
            self.section = group_title(heading[1].title())
            return None
        if not line or stated is None or ("商品構成" in line or "全" in line or "collect all" in line.lower()) and _WHOLE.search(line):
            return None
        count, end = stated
        title = group_title(line[:end])
        bare = plain(title)
        major = line.startswith(MAJOR_MARKS) or any(w in bare for w in MAJOR_WORDS)
        key = (bare, count, plain(self.section))
        if not 0 < count <= MOST or title.lower() in ("", "type", "card") or key in self.seen:
            return None
        self.seen.add(key)
        self.n += 1
        row = self.n, f"COMP-{self.n:03d}", title if major else self.section, title, count, line
        if major or line.startswith("●"):
            self.section = title
        return row


@udtf(returnType=COMPOSITION)
class Composition:
    """The same as a table function, called with a table of (release, line) partitioned by release and in the order of its lines."""

    def __init__(self):
        self.sections = Sections()

    def eval(self, row) -> Iterator[tuple]:
        if (found := self.sections.group(row["line"])) is not None:
            yield row["release"], *found

    def terminate(self):
        return iter(())


_ROWS = pa.schema([("release", pa.string()), ("sequence", pa.int32()), ("code", pa.string()), ("section", pa.string()), ("title", pa.string()), ("announced", pa.int32()), ("description", pa.string())])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (release, line), all of a release one after the other. Only one release is open at a time."""
    own, now = None, None
    for b in batches:
        rows = []
        for release, line in zip(b.column("release").to_pylist(), b.column("line").to_pylist(), strict=True):
            if now is None or release != own:
                own, now = release, Sections()
            if (row := now.group(line)) is not None:
                rows.append((release, *row))
        columns = list(zip(*rows, strict=True)) or [()] * len(_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def composition_lines(texts: DataFrame) -> DataFrame:
    """(release, place, line) of the lines between the first start and the end after it, of texts (release, text)."""
    lines = texts.select("release", F.posexplode(F.split("text", "\r?\n")).alias("place", "line"))
    has = lambda marks: F.lower("line").rlike("|".join(re.escape(m.lower()) for m in marks))
    own = Window.partitionBy("release")
    start = F.coalesce(F.min(F.when(has(STARTS), F.col("place"))).over(own), F.lit(0))
    lines = lines.withColumn("start", start)
    end = F.min(F.when(has(ENDS) & (F.col("place") > F.col("start")), F.col("place"))).over(own)
    return lines.withColumn("end", end).where("place >= start AND (end IS NULL OR place < end)").select("release", "place", "line")


def compositions(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The groups of each release of (release, place, line). Lines of one release are folded in order, by one task, without being gathered."""
    dealt = lines.select(F.col("release").cast("string").alias("release"), "place", "line").repartition("release").sortWithinPartitions("release", "place")
    return dealt.select("release", "line").mapInArrow(_folded, COMPOSITION)


def announced_total(text):
    """The number of designs that a page announces, the first way of saying so that fits; 0 if none."""
    found = [F.regexp_extract(text, f"(?i){way}", 1).try_cast("int") for way in TOTALS]
    fits = [F.when(F.coalesce(f, F.lit(0)).between(1, MOST), f) for f in found]
    return F.coalesce(*fits, F.lit(0))


def card_codes(rows: DataFrame) -> DataFrame:
    """(release, sequence, code, rarity) of rows (release, place, text): each code once, where it stands first. Years and the words for
    volumes and pages are none. Numbered by release, so rows of one release meet."""
    text = F.col("text")
    low = F.lower(F.trim(text))
    other = F.lit(False)
    for w in OTHER_ROWS:
        other = other | F.contains(low, F.lit(w))
    codes = F.regexp_extract_all(text, F.lit(CODE), F.lit(1))
    found = F.when(F.size(codes) > 0, codes).otherwise(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)))
    label = F.coalesce(*(F.when(F.contains(low, F.lit(r)), r) for r in RARITIES), F.lit(""))
    c = rows.where(~other | F.contains(low, F.lit("card"))).select("release", "place", label.alias("rarity"), F.posexplode(found).alias("at", "raw"))
    c = c.withColumn("code", F.ltrim(F.regexp_replace("raw", r"\s+", ""), F.lit("#")))
    c = c.where(~F.col("code").isin(*YEARS) & ~F.col("code").rlike(f"^({'|'.join(NOT_CODES)})") & (F.col("code") != ""))
    first = c.groupBy("release", "code").agg(F.min(F.struct("place", "at", "rarity")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("release").orderBy("f.place", "f.at"))
    return first.select("release", nth.alias("sequence"), "code", "f.rarity")
