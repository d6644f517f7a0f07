"""Quality rules (operator 4), native: line-first cleaning.

Each line with a word is judged by three rules; lines that fail are taken out, and a document that loses too much
of its text is rejected.

* punctuation: more than 10 characters in 100 are of ``#*$%&<>!?=~^{}``
* navigation: three separators ``|`` or more, and more than 4 characters in 100 are separators
* boilerplate: the line holds a phrase of BOILERPLATE (any case)

A document goes if punctuation and navigation take more than half of the characters in its lines, or all three rules
together more than nine tenths.

Defined results: null, empty and blank texts have no words and fail the base rule. Lines without a word are not judged and
stay. Each row is judged by itself, so repeated rows, and null or repeated doc_ids, are rows like others, and there are
no ties. An empty table gives no rows; extra columns, whatever their names, go along untouched where documents are
returned. A very long text is held by one task as arrays of its words and lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import SPACES, Stash, keyed, sized

#: Phrases of licence, consent and navigation lines.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "skip to content", "back to top",
)
SYMBOLS = "#*$%&|<>"
PUNCTUATION_IN_100, SEPARATORS_IN_100, LOST_IN_100, ALL_LOST_IN_100 = 10, 4, 50, 90


def has_word(line):
    return line.rlike(r"[^ \x09-\x0D]")


def verdict(line):
    """(chars, noisy, boilerplate) of a line."""
    n = F.length(line)
    marks = F.length(F.regexp_replace(line, r"[^#*$%&<>!?=~^{}]+", ""))
    bars = n - F.length(F.replace(line, F.lit("|"), F.lit("")))
    noisy = (marks * 100 > n * PUNCTUATION_IN_100) | ((bars >= 3) & (bars * 100 > n * SEPARATORS_IN_100))
    known = F.lit(False)
    low = F.lower(line)
    for phrase in BOILERPLATE:
        known = known | F.contains(low, F.lit(phrase))
    return F.struct(n.alias("n"), noisy.alias("noisy"), known.alias("known"))


def line_verdicts(lines):
    """Array of (chars, noisy, boilerplate) for an array of lines."""
    return F.transform(lines, verdict)


def cleaned_text(text):
    """The text without the lines that fail a rule; lines without a word are not judged and stay."""
    fails = lambda line: has_word(line) & (verdict(line)["noisy"] | verdict(line)["known"])
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~fails(line)), "\n")


def quality_columns(docs: DataFrame) -> DataFrame:
    """doc_id and all measures and verdicts of each document of (doc_id, text)."""
    return _measured(docs).drop("did", "rid")


def _measured(docs: DataFrame) -> DataFrame:
    df = keyed(docs).withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), has_word))
    df = df.select(
        "doc_id",
        "did",
        "rid",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(words) >= 6 THEN transform(sequence(0, size(words) - 5),"
            " i -> xxhash64(words[i], words[i+1], words[i+2], words[i+3], words[i+4])) END"
        ).alias("windows"),
    )
    df = df.withColumn("verdicts", line_verdicts(F.col("lines")))
    df = df.withColumn(
        "ranked",
        F.expr(
            "CASE WHEN size(windows) > size(array_distinct(windows))"
            " THEN sort_array(transform(windows, (x, i) -> struct(x AS h, i AS i))) END"
        ),
    )
    df = df.withColumn(
        "at",
        F.expr(
            "sort_array(transform(filter(sequence(0, size(ranked) - 1), k -> (k > 0 AND ranked[k].h = ranked[k-1].h)"
            " OR (k < size(ranked) - 1 AND ranked[k].h = ranked[k+1].h)), k -> ranked[k].i))"
        ),
    )
    repeated = F.expr(
        "coalesce(aggregate(at, struct(0 AS n, 0 AS e), (a, p) -> struct(a.n + 5 - greatest(0, a.e - p) AS n, p + 5 AS e),"
        " a -> a.n), 0)"
    ).cast("long")
    total = lambda what: F.aggregate(
        "verdicts", F.lit(0).cast("long"), lambda a, v: a + F.when(what(v), v["n"]).otherwise(0).cast("long")
    )
    df = df.select(
        "doc_id", "did", "rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"),
        total(lambda v: F.lit(True)).alias("line_chars"),
        total(lambda v: v["noisy"]).alias("noisy_chars"),
        total(lambda v: v["noisy"] | v["known"]).alias("removed_chars"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    lost = (F.col("noisy_chars") * 100 > F.col("line_chars") * LOST_IN_100) | (
        F.col("removed_chars") * 100 > F.col("line_chars") * ALL_LOST_IN_100
    )
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def _kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, text) of the documents that pass; the columns of `docs`, whatever their names, are in `row`.

    The verdicts are stored first: a filter on them would be pushed below the columns that they are made of, and
    everything would be computed again for the filter.
    """
    verdicts = Stash(spark).put(_measured(docs).select("did", "rid", "kept"), "verdicts")
    bad = sized(verdicts.where("NOT kept").select("did", "rid"), 24)
    return keyed(docs, F.struct("*").alias("row")).join(bad, ["did", "rid"], "left_anti").select("row", "text")


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    return _kept_rows(spark, docs).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def cleaned_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that pass, with their passing lines as text. n_chars follows the text."""
    df = _kept_rows(spark, docs).withColumn("cleaned", cleaned_text(F.col("text")))
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cleaned") == F.col("text"), F.col("row.n_chars")).otherwise(F.length("cleaned").cast("long"))
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
