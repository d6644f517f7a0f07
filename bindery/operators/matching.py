"""Matching offers to a bibliography."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import texts

#: Words of offers of several books, and the word for a photobook beside which a short title counts.
BUNDLES = ("セット", "まとめ")
VOLUMES = "冊"
LABEL = "写真集"
OPENING, CLOSING = "『「\"'", "』」\"'"
#: Characters of the pieces by which titles and aliases meet.
PIECE = 2


def _pieces(text: Column) -> Column:
    """The different substrings of PIECE characters; the text itself if it is shorter."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - PIECE + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(PIECE)))
    return F.when(n > 0, F.array_distinct(cut))


def _set_apart(title: Column, alias: Column) -> Column:
    """Whether the alias stands somewhere in marks, or beside LABEL: what is left and right of each place decides."""
    around = F.split(title, F.concat(F.lit("\\Q"), alias, F.lit("\\E")), -1)

    def here(i: Column) -> Column:
        left, right = F.get(around, i - 1), F.get(around, i)
        opened, closed = F.right(left, F.lit(1)).isin(*OPENING), F.left(right, F.lit(1)).isin(*CLOSING)
        bare = F.when(opened, F.substr(left, F.lit(1), F.length(left) - 1)).otherwise(left)
        leads = F.endswith(bare, F.lit(LABEL)) & (closed | ((right == "") & (i == F.size(around) - 1)))
        return (opened & closed) | leads | ((i == 1) & (left == "") & F.startswith(right, F.lit(LABEL)))

    return (F.size(around) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(around) - 1, F.lit(1))), here)


def match_books(items: DataFrame, books: DataFrame) -> DataFrame:
    """(item_id, book_id, method) of physical items (item_id, title, isbn) that point to exactly one of `books`
    (book_id, alias, isbn): by ISBN where the item has one, else by an alias contained in the title.

    Offers of several books match nothing. A Latin alias of five letters or fewer also stands in names and other titles,
    so it must be quoted, or stand beside the word for a photobook. Containment has no key of its own: an alias is looked
    up by its rarest piece of PIECE characters among the pieces of all titles, then compared.
    """
    digits = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9X]", "")
    title = F.coalesce("title", F.lit(""))
    items = items.where(~title.rlike(f"{'|'.join(map(re.escape, BUNDLES))}|[0-9]+{VOLUMES}"))
    items = items.select("item_id", digits(F.col("isbn")).alias("i"), texts.nfkc_spaced(title).alias("t"))
    books = books.select("book_id", digits(F.col("isbn")).alias("b"), texts.nfkc_spaced(F.col("alias")).alias("a"))
    by_isbn = items.where("i <> ''").join(books.where("b <> ''"), F.col("i") == F.col("b")).select("item_id", "book_id", F.lit("isbn").alias("method"))

    named = items.where("i = ''").select("item_id", "t", F.explode(_pieces(F.col("t"))).alias("piece"))
    counts = named.groupBy("piece").agg(F.count("*").alias("n"))
    pieces = books.where("a <> ''").select("book_id", "a", F.explode(_pieces(F.col("a"))).alias("piece")).join(counts, "piece", "left")
    # A piece that no title has can't lead anywhere; it is the rarest, and its join is empty.
    rarest = pieces.groupBy("book_id", "a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
    near = named.join(rarest.select("book_id", "a", F.col("p.piece").alias("piece")), "piece").where(F.contains("t", F.col("a")))
    short = F.col("a").rlike("^[a-z]{1,5}$")
    good = ~short | _set_apart(F.col("t"), F.col("a"))
    by_title = near.where(good).select("item_id", "book_id", F.lit("title").alias("method"))
    found = by_isbn.unionByName(by_title).distinct()
    one = found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("book_id").alias("book_id"), F.min("method").alias("method"))
    return one.where("n = 1").drop("n")
