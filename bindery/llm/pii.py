"""Personal data (operator 1), native: fixed patterns as seeds, contexts learned from them, and what these discover.

Seeds are the spans of four fixed patterns. Every seed, and every other token that holds an ``@`` or three digits, is an
instance; its contexts (the word before, the two words before, the words on both sides)
are patterns. On the pattern-instance graph a pattern's confidence for a kind is the score of the different
instances it takes in, over their number plus one, if `min_seeds` different seeds back it; an instance's score is the
noisy-or of its patterns. After `rounds` rounds the tokens that score `accept` or more become spans of that kind.
Base spans always stay. Context words are whole words; one that doesn't end within WINDOW characters of the instance is
no context.

Defined results: null and empty texts have no spans. Rows with one doc_id and one text are one document and share its
result; rows of one doc_id with different texts, and null doc_ids, are documents of their own. Of kinds with equal scores
the first in KINDS wins. An empty table gives no rows; other columns, whatever their names, are not looked at. A very long
text is held by one task, with its instances as an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import Stash, keyed

KINDS = ("email", "ip", "card", "phone")
#: Java regexes, without steps back, so that they run in linear time; each matches what its contract's pattern does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
WINDOW = 256


def _digits(c):
    return F.length(F.regexp_replace(c, "[^0-9]+", ""))


def _spans(df: DataFrame, name: str, pattern: str, needs, keep) -> DataFrame:
    """Adds column `name`: array of (start, end) of the matches that pass."""
    df = df.withColumn("_gaps", F.when(needs, F.split("text", pattern, -1)))
    df = df.withColumn("_hits", F.when(needs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"))
        out = F.when(keep(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    pairs = F.transform("_hits", lambda h, i: F.struct(h.alias("hit"), F.get("_gaps", i).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    found = F.when(F.size("_hits") > 0, F.aggregate(pairs, start, step, lambda a: a["out"]))
    return df.withColumn(name, F.coalesce(found, empty)).drop("_gaps", "_hits")


def base_and_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, did, rid, base, tokens): arrays of (start, kind, end, text, l1, l2, r1) of the fixed patterns and of other tokens."""
    df = keyed(docs)
    digit = F.col("text").rlike("[0-9]")
    df = _spans(df, "email", EMAIL, F.contains("text", F.lit("@")), lambda h: F.lit(True))
    df = _spans(df, "ip", IP, digit, lambda h: h.rlike(OCTETS))
    bare = lambda h: F.regexp_replace(h, "[ -]", "")
    df = _spans(df, "card", CARD, digit, lambda h: (F.length(bare(h)) <= 19) & F.call_function("luhn_check", bare(h)))
    df = _spans(df, "phone", PHONE, F.contains("text", F.lit("+")), lambda h: _digits(h).between(9, 15))
    plausible = lambda h: F.contains(h, F.lit("@")) | (_digits(h) >= 3)
    df = _spans(df, "token", TOKEN, digit | F.contains("text", F.lit("@")), plausible)

    def detail(x, kind):
        s, e = x["start"], x["end"]
        # A blank stands for the text's ends, so that every whole word has something beside it.
        before = F.concat(F.when(s <= WINDOW, " ").otherwise(""), F.substr("text", F.greatest(s - WINDOW, F.lit(0)) + 1, F.least(s, F.lit(WINDOW))))
        after = F.concat(F.substr("text", e + 1, F.lit(WINDOW)), F.when(F.length("text") - e <= WINDOW, " ").otherwise(""))
        word = lambda c, rx: F.lower(F.regexp_extract(c, rx, 1))
        return F.struct(
            s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"), F.lower(F.substr("text", s + 1, e - s)).alias("text"),
            word(before, r"[^\p{L}](\p{L}+)[^\p{L}\n]*$").alias("l1"), word(before, r"[^\p{L}](\p{L}+[^\p{L}\n]+\p{L}+)[^\p{L}\n]*$").alias("l2"),
            word(after, r"^[^\p{L}\n]*(\p{L}+)[^\p{L}]").alias("r1"),
        )

    details = lambda column, kind: F.transform(column, lambda x: detail(x, kind))
    arrays = [details(k, i) for i, k in enumerate(KINDS)]
    df = df.withColumn("base", F.sort_array(F.concat(*arrays)))
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return df.select("doc_id", "did", "rid", "base", details(F.filter("token", free), -1).alias("tokens"))


def discover(stash: Stash, found: DataFrame, rounds: int, min_seeds: int, accept: float) -> DataFrame:
    """(did, rid, start, end, kind) of the tokens that learned contexts vouch for."""
    inst = found.select(F.explode(F.concat("base", "tokens")).alias("x")).select("x.*")
    context = F.array(
        F.when(F.col("l1") != "", F.concat(F.lit("1 "), "l1")),
        F.when(F.col("l2") != "", F.concat(F.lit("2 "), "l2")),
        F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("3 "), "l1", F.lit(" _ "), "r1")),
    )
    edges = inst.select(F.explode(F.array_compact(context)).alias("pattern"), "text", "kind")
    # One edge for a pattern and an instance, however often they meet; a surface seen as a seed is a seed.
    edges = stash.put(edges.groupBy("pattern", "text").agg(F.max("kind").alias("kind")), "edges")
    backed = edges.where("kind >= 0").groupBy("pattern", "kind").count().where(F.col("count") >= min_seeds).select("pattern", "kind")
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    backed = stash.put(backed.join(total, "pattern"), "patterns")
    seeds = edges.where("kind >= 0").groupBy("text", "kind").agg(F.lit(1.0).alias("score"))
    scores = seeds
    for i in range(rounds):
        held = edges.select("pattern", "text").join(scores, "text").groupBy("pattern", "kind").agg(F.sum("score").alias("held"))
        confidence = backed.join(held, ["pattern", "kind"]).select("pattern", "kind", (F.col("held") / (F.col("n") + 1)).alias("c"))
        open_edges = edges.where("kind < 0").select("pattern", "text").join(confidence.where("c > 0.2"), "pattern")
        new = open_edges.groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(0.999)))))).alias("score"))
        scores = stash.put(seeds.unionByName(new), f"scores{i}")
    good = scores.join(seeds.select("text").distinct(), "text", "left_anti").where(F.col("score") >= accept)
    best = good.groupBy("text").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    tokens = found.select("did", "rid", F.explode("tokens").alias("x")).select("did", "rid", "x.start", "x.end", "x.text")
    return tokens.join(best, "text").select("did", "rid", "start", "end", "kind")


def _joined(column: str):
    return F.array_join(
        F.transform(
            column, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
        ),
        ",",
    )


def find_pii(spark: SparkSession, docs: DataFrame, rounds: int = 2, min_seeds: int = 3, accept: float = 0.75) -> DataFrame:
    """One row for each document: counts and digest of base spans, and all spans."""
    stash = Stash(spark)
    found = stash.put(base_and_candidates(docs), "found")
    more = discover(stash, found, rounds, min_seeds, accept)
    more = more.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    short = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = found.select("doc_id", "did", "rid", short.alias("base")).join(more, ["did", "rid"], "left")
    out = out.withColumn("all", F.sort_array(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))))
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    n = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all").alias("spans"))
