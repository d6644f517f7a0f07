"""Line dedup (operator 2), native: an exact set-similarity join of lines, of which later matches are removed.

A line's set is its distinct words (as they are written). A line with a word is removed if an earlier line, in the order
of doc_id and line number, has a Jaccard similarity of 0.8 or more with it, whether that line is itself removed or not.

Words are ordered by rarity. The lines that hold a word are counted over all documents in hashed counters, BUCKETS of them or
more, as the words are more, and a word ranks by the level (a quarter of a power of two) of its counter, then by hash: one order
for all lines, whatever share a counter. A word whose counter is one stands in no other line and is skipped. Equal sets are one class, kept at its
first line. Classes meet on the words of their prefixes, within bands of sizes; a word of more than HOT lines meets only
together with a word after it in the prefix, which is one word longer then. What meets is dealt with in passes over the keys, so
that the shuffled rows of one pass stay in proportion to the classes. Length, positional and parity-sketch filters are
part of the join, and what passes is verified on whole sets. Before that,
crowds of near copies shrink. In a crowd, the words that its members share are the frequent ones of their prefixes, so
classes that share one of the STAR most frequent words of their prefixes are compared with two of them, the earliest one
and the earliest of those without rare words. What is removed there is looked at as the earlier line of a pair only. Of the
candidates that a line has in the end, the one with the nearest sketch is verified first, the others only if that fails.

Defined results: null, empty and blank texts have no line that is removed. Lines without a word stay. Of equal lines the
first stays, ties go to the smaller doc_id, then to the smaller hash of the text, then to the line number. Rows with one
doc_id and one text are one document and all get its result; rows with one doc_id and different texts are different
documents. A null doc_id comes before all others. An empty table gives no rows. Other columns, whatever their names, are
not looked at. A very long text is split into its lines within one task, which holds it once as an array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Stash, keyed, sized

#: Counters of words' lines, at least and at most, and words for which there is one; they bound what the driver collects and
#: what a plan carries.
BUCKETS, MOST_BUCKETS, CROWD = 1 << 16, 1 << 20, 1 << 10
#: Rows of prefixes for each class that one pass shuffles.
PASS_ROWS = 12
#: Words of more lines meet in pairs only.
HOT = 1 << 12
#: Smaller sets are similar to equal ones only, which are one class.
JOINED = 4
#: Words by which a class finds the crowd that it may be in.
STAR = 6
#: Larger sets have a wider sketch, as more of their words may differ.
WIDE = 80


def _plain(text):
    """Tabs, vertical tabs, form feeds and carriage returns as spaces."""
    odd = "\t\x0b\f\r"
    has = F.contains(text, F.lit(odd[0]))
    for c in odd[1:]:
        has = has | F.contains(text, F.lit(c))
    return F.when(has, F.translate(text, odd, " " * len(odd))).otherwise(text)


def _hashes(line):
    """Distinct hashes of the words of a line of _plain text."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _level_of(count: int) -> int:
    return int(min(127, 4 * np.log2(count)))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(did, rid, line, h): the word hashes of each line of keyed documents."""
    lines = docs.select("did", "rid", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "t")).where("t <> ''")
    return lines.select("did", "rid", "line", _hashes(F.col("t")).alias("h"))


def counters(hashed: DataFrame) -> int:
    """How many counters the words of the lines get: a power of two that grows with them."""
    words = hashed.agg(F.sum(F.size("h")).alias("n")).first()["n"] or 0
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (words // CROWD).bit_length()))


def word_levels(hashed: DataFrame) -> np.ndarray:
    """The level of each counter."""
    buckets = counters(hashed)
    bucket = F.col("w").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("bucket")
    counted = hashed.select(F.explode("h").alias("w")).select(bucket).groupBy("bucket").count().toArrow()  # at most MOST_BUCKETS rows
    n = np.ones(buckets)
    n[counted["bucket"].to_numpy()] = counted["count"].to_numpy()
    return np.minimum(127, np.floor(4 * np.log2(n))).astype(np.int64)


def line_sets(hashed: DataFrame, levels: np.ndarray) -> DataFrame:
    """(did, rid, line, cls, n, flips, more, low, prefix) of each line; without a word, n is 0.

    `flips` is a sketch of 64 parity bits: their Hamming distance can't exceed the words in one of two sets only. `more`
    is the part of it that half of the words (by hash) make up, 0 for sets of WIDE words or fewer: the two halves apart are
    a sketch of 128 bits. `low` is the level of the rarest word. `prefix`
    is the prefix and one word more, as 31-bit tokens: 0 for a word that stands nowhere else, negative for a hot one.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    level = F.split(F.lit(",".join(map(str, levels << 56))), ",").cast("array<bigint>")
    # No level is null; where the plan says so, plain numbers are sorted.
    rank = lambda h: F.coalesce(F.get(level, h.bitwiseAND(F.lit(len(levels) - 1)).cast("int")), none).bitwiseOR(F.shiftrightunsigned(h, 8))
    df = hashed.select("did", "rid", "line", F.sort_array(F.transform("h", rank)).alias("s"))
    n = F.size("s")
    hot = F.lit(_level_of(HOT) + 1 << 56)
    token = lambda k: F.when(k < F.lit(1 << 56), 0).when(k >= hot, -_token(k)).otherwise(_token(k))
    bit = lambda k: k.bitwiseAND(F.lit(63)).cast("int")
    flips = F.aggregate("s", none, lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", one, bit(k))))
    half = F.aggregate("s", none, lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.shiftright(k, 6).bitwiseAND(one), bit(k))))
    prefix = F.when(n >= JOINED, F.transform(F.slice("s", F.lit(1), n - F.expr("(4 * size(s) + 4) div 5").cast("int") + 2), token))
    return df.select(
        "did", "rid", "line", F.xxhash64("s").alias("cls"), n.alias("n"), flips.alias("flips"), F.when(n > WIDE, half).otherwise(none).alias("more"),
        F.shiftright(F.get("s", F.lit(0)), 56).cast("int").alias("low"), prefix.alias("prefix"),
    )


def _token(k):
    """31 bits of a word's hash, never 0: that stands for words without partners."""
    return F.greatest(k.bitwiseAND(F.lit((1 << 31) - 1)), F.lit(1).cast("long")).cast("int")


def _band():
    """Number of the band of sizes, each from a power of two up to the next."""
    return F.floor(F.log2("n")).cast("int")


def _prefix_words(classes: DataFrame, index: bool = False, passes: int = 1, k: int = 0) -> DataFrame:
    """(key, cid, did, np, flips, more): the words of pass `k` in the prefix of each class by which it meets sets of no more words, in its
    own band of sizes and, if partners can be there, the one below; with `index` those by which it is met, in its own band.

    Sets of n and m words must have 4/9 of n + m in common, all of them from the first one on. So that is among fewer words where the
    other set is the larger one, or has the least size of the own band or more. `np` is the set's size, 32 bits, the word's position
    in the order, 31 bits, and whether the class is still to be removed.
    """
    band, size = _band(), F.size("prefix") - 1
    least = F.call_function("shiftleft", F.lit(1), band)
    common = F.expr("(4 * n + 4) div 5").cast("int")
    if index:
        size = own = F.expr("n - (8 * n + 8) div 9 + 1").cast("int")
        below = F.lit(0)
    else:
        own = F.col("n") - F.greatest(common, F.call_function("div", (least + F.col("n")) * 4 + 8, F.lit(9)).cast("int")) + 1
        below = F.when(common < least, size).otherwise(0)
    whole = F.col("n").cast("long") * (1 << 32) + (F.col("open") == F.col("did")).cast("long")
    columns = ("cid", "did", whole.alias("np"), "flips", "more", band.alias("band"), own.alias("own"), below.alias("below"))
    words = F.posexplode(F.slice("prefix", F.lit(1), size)).alias("i", "tok")
    same = ("cid", "did", (F.col("np") + F.col("i") * 2).alias("np"), "flips", "more")
    rest = ("cid", "did", "np", "flips", "more")
    cold = classes.select(*columns, words).where("tok > 0")
    if passes > 1:
        cold = cold.where(F.pmod("tok", F.lit(passes)) == k)
    key = F.col("tok").cast("long") * 64 + F.col("band")
    keys = F.when(F.col("below") == 0, F.array(key)).when(F.col("i") < F.col("own"), F.array(key, key - 1)).otherwise(F.array(key - 1))
    cold = cold.select(key.alias("key") if index else F.explode(keys).alias("key"), *same)
    # After a hot word all are hot. Two sets that share no cold word share two hot ones, and meet on the first of them with the second.
    hot = classes.where(F.element_at("prefix", -1) < 0).select(*columns, "prefix", words).where("tok < 0")
    bands = F.explode(F.array(F.struct("band", F.col("own").alias("size")), F.struct((F.col("band") - 1).alias("band"), F.col("below").alias("size")))).alias("to")
    hot = hot.select(*same, "i", "tok", "prefix", bands).where("i < to.size")
    hot = hot.select(*rest, "tok", "to.band", F.explode(F.slice("prefix", F.col("i") + 2, F.col("to.size") - F.col("i"))).alias("other"))
    hot = hot.select(F.xxhash64("tok", "other", "band").alias("key"), *rest)
    if passes > 1:
        hot = hot.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k)
    return cold.unionByName(hot)


def _far():
    """Words in one of two sets only, at least: the distance of the sketches. Where one of two sets has no halves, the whole
    sketch decides."""
    whole = F.col("x.flips").bitwiseXOR(F.col("y.flips"))
    half = F.col("x.more").bitwiseXOR(F.col("y.more"))
    return lambda nx, ny: F.when(F.least(nx, ny) > WIDE, F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))


def _near(nx, ny):
    """Whether sizes and sketches allow a Jaccard similarity of 4/5: at most a ninth of the sizes' sum stands in one set only."""
    return (F.least(nx, ny) * 5 >= F.greatest(nx, ny) * 4) & (_far()(nx, ny) * 9 <= nx + ny)


def _star(classes: DataFrame) -> DataFrame:
    """(a, b): classes that share a frequent word of their prefixes and their band, with two centres of the group: the earliest
    class and the earliest without rare words. Which centres are taken matters for the effort only."""
    size = F.size("prefix") - 1
    words = F.slice("prefix", F.greatest(size - STAR + 1, F.lit(1)), F.least(size, F.lit(STAR)))
    rank = F.shiftleft((127 - F.col("low")).cast("long"), 56).bitwiseOR(F.col("did").bitwiseAND(F.lit((1 << 56) - 1)))
    rows = classes.select("did", "cid", "n", "flips", "more", rank.alias("rank"), F.explode(words).alias("tok")).where("tok <> 0")
    rows = rows.select((F.col("tok").cast("long") * 64 + _band()).alias("key"), "did", "rank", "cid", "n", "flips", "more")
    own = ("cid", "n", "flips", "more")
    # Plain numbers one by one, as structs would have to be sorted by their keys.
    least = (F.min_by(x, by).alias(f"{by}_{x}") for by in ("did", "rank") for x in own)
    best = rows.groupBy("key").agg(*least, F.count("*").alias("k")).where("k > 1")
    centre = F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"{by}_{x}").alias(x) for x in own)) for by in ("did", "rank"))))).alias("c")
    centres = best.select("key", centre).select("key", "c.*")
    x, y = centres.select("key", "cid", "n", "flips", "more").alias("x"), rows.select("key", "cid", "n", "flips", "more").alias("y")
    fits = (F.col("x.cid") != F.col("y.cid")) & _near(F.col("x.n"), F.col("y.n"))
    return x.join(y, "key").where(fits).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def _passes(classes: DataFrame) -> int:
    """Passes over the keys in which classes meet, from the rows of their prefixes."""
    size, last = F.size("prefix") - 1, F.element_at("prefix", -1) < 0  # hot words are the last
    hot = F.when(last, F.size(F.filter(F.slice("prefix", F.lit(1), size), lambda t: t < 0))).otherwise(0).cast("double")
    rows = F.col("size") - F.col("hot") + F.col("hot") * (F.col("hot") + 1) / 2
    # By about half as many words it is met.
    x = classes.select(size.alias("size"), hot.alias("hot")).agg(F.count("*").alias("n"), F.sum(rows * 3 / 2).alias("rows")).first()
    return max(1, int(np.ceil((x["rows"] or 0) / (PASS_ROWS * max(1, x["n"])))))


def _met(stash: Stash, classes: DataFrame) -> DataFrame:
    """_meeting in passes. Two classes may meet in several, always at one distance."""
    passes = _passes(classes)
    parts = [stash.put(_meeting(classes, passes, k), "met", joins=True) for k in range(passes)]
    if passes == 1:
        return parts[0]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    met = stash.put(whole.groupBy("a", "b", "within").agg(F.min("far").alias("far")), "met")
    stash.drop(*parts)
    return met


def _meeting(classes: DataFrame, passes: int = 1, k: int = 0) -> DataFrame:
    """(a, b, within, far): classes and later ones whose prefixes meet on a key of pass `k`, if sizes, positions and sketches allow enough
    overlap and the later one is still open. `within` one document, either may be the later one."""
    x, y = _prefix_words(classes, True, passes, k).alias("x"), _prefix_words(classes, False, passes, k).alias("y")
    nx, ny = (F.shiftright(f"{c}.np", 32) for c in "xy")
    i, j = (F.shiftright(F.col(f"{c}.np").bitwiseAND(F.lit((1 << 32) - 1)), 1) for c in "xy")
    # Of the first common word of both prefixes, the words from there on must make up 4/9 of the sizes' sum.
    rest = F.least(nx - i, ny - j)
    once = (nx < ny) | ((nx == ny) & (F.col("x.cid") < F.col("y.cid")))
    x_open, y_open = (F.col(f"{c}.np").bitwiseAND(F.lit(1)) == 1 for c in "xy")
    before, after = F.col("x.did") < F.col("y.did"), F.col("x.did") > F.col("y.did")
    ordered = F.when(before, y_open).when(after, x_open).otherwise(x_open | y_open)
    fits = once & (rest * 9 >= (nx + ny) * 4) & _near(nx, ny) & ordered  # the cheapest first
    swap = after | (~before & (F.col("x.cid") > F.col("y.cid")))
    end = lambda c, d: F.when(swap, F.col(f"{d}.cid")).otherwise(F.col(f"{c}.cid"))
    met = x.join(y, "key").where(fits).select(end("x", "y").alias("a"), end("y", "x").alias("b"), (~before & ~after).alias("within"), _far()(nx, ny).alias("far"))
    return met.groupBy("a", "b", "within").agg(F.min("far").alias("far"))


def _sets(stash: Stash, pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, did, rid, line, s): the whole sets of the classes of stored pairs (a, b)."""
    where = classes.select("cid", "did", "rid", "line")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(where, "cid")
    wanted = stash.put(wanted.groupBy("did", "rid").agg(F.collect_list(F.struct("line", "cid")).alias("ls")), "wanted", joins=True)
    got = docs.join(sized(wanted, F.size("ls") * 24 + 64), ["did", "rid"]).select("did", "rid", "ls", F.split(_plain(F.col("text")), "\n").alias("all"))
    sets = got.select("did", "rid", "all", F.explode("ls").alias("l"))
    sets = sets.select("did", "rid", "l.line", "l.cid", _hashes(F.get("all", F.col("l.line"))).alias("s"))  # several times if a row is repeated
    sets = stash.put(sets, "sets", hashes=True)
    stash.drop(wanted)
    return sets


def _later(stash: Stash, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, did, rid, line): the later class of each pair (a, b) of classes whose sets are similar enough."""
    side = lambda c: sets.select(F.col("cid").alias(c), *(F.col(v).alias(f"{c}_{v}") for v in ("did", "rid", "line", "s")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("a_s", "b_s")))
    same = both.where(F.col("i") * 5 >= (F.size("a_s") + F.size("b_s") - F.col("i")) * 4)
    end = lambda c: F.struct(F.col(f"{c}_did").alias("did"), F.col(f"{c}_rid").alias("rid"), F.col(f"{c}_line").alias("line"), F.col(c).alias("cid"))
    return stash.put(same.select(F.greatest(end("a"), end("b")).alias("x")).select("x.*").distinct(), "late", joins=True)


def removed_lines(stash: Stash, docs: DataFrame) -> DataFrame:
    """(did, rid, gone, n_exact): the sorted numbers of the removed lines of each document of keyed `docs` that has any."""
    # Filtered when stored: before that, the filter would compute every set once more.
    hashed = stash.put(hashed_lines(docs), "hashed", hashes=True)
    lines = stash.put(line_sets(hashed, word_levels(hashed)), "lines", hashes=True)
    stash.drop(hashed)
    words = lines.where("n > 0")
    first = F.min(F.struct("did", "rid", "line", "n", "flips", "more", "low", "prefix")).alias("f")
    classes = words.groupBy("cls").agg(first, F.count("*").alias("k"))
    classes = stash.put(classes.select("cls", "k", "f.*", F.monotonically_increasing_id().alias("cid")), "classes", hashes=True)
    first = classes.where("k > 1").select("cls", F.col("did").alias("d0"), F.col("rid").alias("r0"), F.col("line").alias("l0"))
    other = (F.col("did") != F.col("d0")) | (F.col("rid") != F.col("r0")) | (F.col("line") != F.col("l0"))
    repeated = words.select("did", "rid", "line", "cls").join(sized(first, 48), "cls").where(other)
    again = stash.put(repeated.select("did", "rid", "line").distinct(), "again", joins=True)
    stash.drop(lines)
    joined = classes.where("prefix IS NOT NULL")
    pairs = stash.put(_star(joined), "pairs", joins=True)
    sets = _sets(stash, pairs, classes, docs)
    late = _later(stash, pairs, sets)
    stash.drop(pairs, sets)
    done = sized(late.select("cid", F.lit(-(1 << 63)).alias("open")), 24)
    met = _met(stash, joined.join(done, "cid", "left").withColumn("open", F.coalesce("open", "did")))
    sets = _sets(stash, met, classes, docs)
    nearest = met.groupBy("b").agg(F.min(F.struct("far", "a")).alias("n")).select(F.col("n.a").alias("a"), "b")
    late = late.unionByName(_later(stash, nearest, sets))
    # A class that is removed may still be the earlier one of a pair within its document.
    gone = late.select(F.col("cid").alias("b"), F.lit(True).alias("gone")).distinct()
    more = _later(stash, met.join(gone, "b", "left").where("gone IS NULL OR within").select("a", "b"), sets)
    stash.drop(sets)
    whole = late.unionByName(more).select("did", "rid", "line").distinct().withColumn("again", F.lit(0))
    hit = again.withColumn("again", F.lit(1)).unionByName(whole)
    gone = hit.groupBy("did", "rid").agg(F.array_sort(F.collect_list("line")).alias("gone"), F.sum("again").cast("long").alias("n_exact"))
    gone = stash.put(gone, "gone")
    stash.drop(classes, again, met)
    return gone


def _kept(gone):
    """The text without its lines of the numbers `gone`; null where none goes."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNotNull(), F.array_join(kept, "\n"))


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed, n_exact of every document."""
    docs = keyed(docs)
    gone = removed_lines(Stash(spark), docs)
    df = docs.join(sized(gone, F.size("gone") * 4 + 64), ["did", "rid"], "left")
    return df.select(
        "doc_id",
        F.coalesce(_kept(F.col("gone")), "text").alias("kept_text"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"),
    )


def cleaned_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with their kept lines as text; a document left without a word goes. n_chars follows the text.

    The columns of `docs`, whatever their names, go along as one value.
    """
    rows = keyed(docs, F.struct("*").alias("row"))
    gone = removed_lines(Stash(spark), keyed(docs))
    df = rows.join(sized(gone, F.size("gone") * 4 + 64), ["did", "rid"], "left").select("row", "text", _kept(F.col("gone")).alias("kept"))
    df = df.where(F.coalesce("kept", "text").rlike(r"[^ \x09-\x0D]"))
    new = {"text": F.coalesce("kept", F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
