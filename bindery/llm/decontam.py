"""Benchmark decontamination (operator 6), native: a positional inverted index, intersected from the rarest terms.

Every run of ten words of an item (or the whole item if it is shorter) is a window. Its terms are ranked by how often they
stand in the documents. The index is a stored table of postings (term, document, position) of each window's three rarest
terms. A window is looked up by its rarest term; the positions, less the term's place in the window, are the starts where
it could be. These are intersected with the postings of the second and the third rarest term, adjusted in the same way,
and what remains is compared word by word. All words of a found window count as hit. A proximity match is weaker and only
reported: all three terms stand within nine words of the rarest one.

Everything is joins on keys: on a term, then on document, term and position, so a frequent term is spread by document, and a
hot document by position. The number of items and of windows has no bound; only tables of a checked size are broadcast.

Defined results: null and empty texts have no words and no hits. Repeated items and windows are matched like others, once
for each item. Rows with one doc_id and one text are one document and share its result; rows of one doc_id with different
texts are different documents. Ties between terms go by the term, then by the place. An empty benchmark hits nothing, an
empty table of documents gives no rows; other columns, whatever their names, are not looked at. A very long text is held
by one task as an array of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import Stash, ascii_lower, keyed, sized

#: Java regex of what stands between words: all ASCII but digits and letters (after lower-casing).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
NEAR = SIZE - 1
#: Positions of one block are looked for in it and in its neighbours.
BLOCK = 16


def tokens(column):
    return F.array_remove(F.split(ascii_lower(column), BETWEEN), "")


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, words) of every distinct window of every item."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    return w.select(
        "item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {NEAR}, 1)), i -> slice(w, i, {SIZE}))")).alias("words")
    ).distinct()


def ranked_windows(stash: Stash, docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(words, terms): the three rarest terms, with their places, of each different window all of whose terms may be found."""
    terms = stash.put(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    seen = docs.select(F.explode("w").alias("term")).join(sized(terms, F.octet_length("term") + 24), "term", "left_semi")
    counts = stash.put(seen.groupBy("term").count(), "counts")
    placed = windows.select("words").distinct().select("words", F.posexplode("words").alias("at", "term"))
    placed = placed.join(sized(counts, F.octet_length("term") + 32), "term", "left").fillna(0, ["count"])
    rank = F.sort_array(F.collect_list(F.struct("count", "term", "at")))
    ranked = placed.groupBy("words").agg(F.slice(rank, 1, 3).alias("terms"))
    out = stash.put(ranked.where(F.get("terms", F.lit(0))["count"] > 0), "ranked")
    stash.drop(terms)
    return out


def stored_postings(stash: Stash, docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """(term, did, rid, pos) of the windows' rarest terms, once for rows that are repeated."""
    wanted = stash.put(ranked.select(F.explode("terms").alias("t")).select("t.term").distinct(), "wanted")
    placed = docs.select("did", "rid", F.posexplode("w").alias("pos", "term"))
    found = placed.join(sized(wanted, F.octet_length("term") + 24), "term", "left_semi")
    return stash.put(found.select("term", "did", "rid", "pos").distinct(), "postings")


def _at(x, i: int):
    return F.get("terms", F.lit(i))[x]


def exact_hits(stash: Stash, docs: DataFrame, ranked: DataFrame, postings: DataFrame) -> DataFrame:
    """(did, rid, start, end, words) of the windows found word by word."""
    lists = ranked.select("words", *(_at(x, i).alias(f"{x}{i}") for i in range(3) for x in ("term", "at")))
    starts = postings.join(lists, F.col("term") == F.col("term0")).withColumn("start", F.col("pos") - F.col("at0")).where("start >= 0").drop("term", "pos")
    for i in (1, 2):
        other = postings.select(F.col("did").alias("d"), F.col("rid").alias("r"), F.col("term").alias("t"), F.col("pos").alias("p"))
        there = (F.col("did") == F.col("d")) & (F.col("rid") == F.col("r")) & (F.col(f"term{i}") == F.col("t")) & (F.col("start") + F.col(f"at{i}") == F.col("p"))
        short = starts.where(F.col(f"term{i}").isNull())
        starts = starts.where(F.col(f"term{i}").isNotNull()).join(other, there, "left_semi").unionByName(short)
    starts = stash.put(starts.select("did", "rid", "start", "words"), "starts")
    near = docs.join(sized(starts.select("did", "rid").distinct(), 24), ["did", "rid"], "left_semi").select("did", "rid", "w").dropDuplicates(["did", "rid"])
    found = starts.join(near, ["did", "rid"]).where(F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words"))
    return found.select("did", "rid", "start", (F.col("start") + F.size("words")).alias("end"), "words")


def near_hits(ranked: DataFrame, postings: DataFrame) -> DataFrame:
    """(did, rid, rare): the triples of rarest terms that stand together in a document."""
    rare = ranked.select(F.transform("terms", lambda t: t["term"]).alias("rare")).distinct()
    rare = rare.select("rare", *(F.get("rare", F.lit(i)).alias(f"term{i}") for i in range(3)))
    places = postings.join(rare, F.col("term") == F.col("term0")).select("did", "rid", "pos", "rare", "term1", "term2")
    for i in (1, 2):
        block = F.floor(F.col("pos") / BLOCK)
        other = postings.select(F.col("did").alias("d"), F.col("rid").alias("r"), F.col("term").alias("t"), F.col("pos").alias("p"), F.floor(F.col("pos") / BLOCK).alias("k"))
        there = (F.col("did") == F.col("d")) & (F.col("rid") == F.col("r")) & (F.col(f"term{i}") == F.col("t")) & (F.col("block") == F.col("k")) & (F.abs(F.col("pos") - F.col("p")) <= NEAR)
        short = places.where(F.col(f"term{i}").isNull())
        places = places.where(F.col(f"term{i}").isNotNull()).withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        places = places.join(other, there, "left_semi").drop("block").distinct().unionByName(short)
    return places.select("did", "rid", "rare").distinct()


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document: word and hit counts, and the items found in it."""
    found = _decontaminated(spark, docs, items)
    return found.drop("did", "rid")


def _decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    stash = Stash(spark)
    docs = keyed(docs).select("doc_id", "did", "rid", tokens(F.col("text")).alias("w"))
    windows = stash.put(item_windows(items), "windows")
    ranked = ranked_windows(stash, docs, windows)
    postings = stored_postings(stash, docs, ranked)
    hits = stash.put(exact_hits(stash, docs, ranked, postings), "hits")
    # Hit words of a document: the union of its found spans, merged in order of their start.
    seen = Window.partitionBy("did", "rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("did", "rid", "start", "end").distinct()
    spans = spans.withColumn("before", F.coalesce(F.max("end").over(seen), F.lit(0)))
    covered = spans.groupBy("did", "rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    rare = windows.join(ranked, "words").select("item_id", F.transform("terms", lambda t: t["term"]).alias("rare")).distinct()
    exact = hits.select("did", "rid", "words").distinct().join(windows, "words").select("did", "rid", "item_id", F.lit(True).alias("exact"))
    close = near_hits(ranked, postings).join(rare, "rare").select("did", "rid", "item_id", F.lit(False).alias("exact"))
    by_item = exact.unionByName(close).groupBy("did", "rid", "item_id").agg(F.max("exact").alias("exact"))
    listed = by_item.groupBy("did", "rid").agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("found"), F.count("*").alias("n_near")
    )
    result = stash.put(listed.join(covered, ["did", "rid"], "left"), "result")
    stash.drop(postings, ranked, hits)
    size = F.coalesce(F.aggregate("found", F.lit(0), lambda a, x: a + F.length(x) + 16), F.lit(0)) + 64
    none = F.lit("")
    return (
        docs.select("doc_id", "did", "rid", F.size("w").cast("long").alias("n_words"))
        .join(sized(result, size), ["did", "rid"], "left")
        .select(
            "doc_id", "did", "rid", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("found", ","), none).cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items"),
        )
    )


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit word. Their columns, whatever their names, go along as one value."""
    bad = _decontaminated(spark, docs, items).where("contaminated").select("did", "rid")
    kept = keyed(docs, F.struct("*").alias("row")).join(bad, ["did", "rid"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
