"""Credit lists of works as lists of aliases of single people: plans over the distinct lists, which are iterated to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import texts
from bindery.storage import Scratch


def _lower(names: Column) -> Column:
    return F.transform(names, lambda x: F.lower(x))


def _latin(names: Column) -> Column:
    return F.exists(names, lambda x: x.rlike("[A-Za-z]"))


def credit_segments(lists: DataFrame, rounds: int = 20) -> DataFrame:
    """(segment, works): the alias lists among comma-separated credit lists (list, works), each the names of one person.

    A segment has two names or more, one of them Latin. A list that begins with another observed list is no segment of its
    own; one that goes on with the first name of another segment is cut before it. Cutting can make segments equal, and
    first names vanish, so it is repeated until nothing changes. Of segments that become equal, the one of most works
    gives the spelling, the first in order of equals.
    """
    split = lists.select(texts.split_list(F.col("list")).alias("names"), "works").where(F.size("names") > 1).groupBy("names").agg(F.sum("works").alias("works"))
    split = split.withColumn("key", _lower(F.col("names")))
    heads = split.select("key", F.explode(F.sequence(F.lit(2), F.greatest(F.size("key") - 1, F.lit(2)))).alias("n")).where("n < size(key)")
    heads = heads.select("key", F.expr("slice(key, 1, n)").alias("head"))
    longer = heads.join(split.select(F.col("key").alias("head")).distinct(), "head", "left_semi").select("key").distinct()
    todo = split.join(longer, "key", "left_anti").where(_latin(F.col("names"))).select("names", "works")
    scratch = Scratch(lists.sparkSession)
    todo = scratch.put(todo, "segments")
    for _ in range(rounds):
        firsts = todo.select(F.lower(F.get("names", F.lit(0))).alias("name")).distinct()
        at = todo.select("names", F.posexplode(_lower(F.col("names"))).alias("i", "name")).where("i > 0 AND name <> lower(names[0])")
        stops = at.join(firsts, "name", "left_semi").groupBy("names").agg(F.min("i").alias("stop"))
        cut = todo.join(stops, "names", "left").select(F.when(F.col("stop").isNull(), F.col("names")).otherwise(F.expr("slice(names, 1, stop)")).alias("names"), "works")
        cut = cut.where((F.size("names") > 1) & _latin(F.col("names")))
        best = Window.partitionBy(_lower(F.col("names"))).orderBy(F.desc("works"), "names")
        new = scratch.put(cut.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place"), "segments")
        if new.exceptAll(todo).limit(1).count() + todo.exceptAll(new).limit(1).count() == 0:
            break
        scratch.drop(todo)
        todo = new
    return todo.select(F.col("names").alias("segment"), "works")


def decompose(lists: DataFrame, segments: DataFrame) -> DataFrame:
    """(list, at, part, known): each list cut into segments, the longest known one at each place, and single names."""
    names = lists.select("list", texts.split_list(F.col("list")).alias("names")).where(F.size("names") > 0)
    known = segments.select(_lower(F.col("segment")).alias("key"), "segment", F.size("segment").alias("n"))
    place = F.explode(F.sequence(F.lit(1), F.size("names"))).alias("at")
    spans = names.select("list", "names", place).select("list", "names", "at", F.explode(F.sequence(F.lit(2), F.greatest(F.size("names") - F.col("at") + 1, F.lit(2)))).alias("n"))
    spans = spans.where("at + n - 1 <= size(names)").select("list", "at", "n", _lower(F.expr("slice(names, at, n)")).alias("key"))
    longest = spans.join(known, ["key", "n"]).groupBy("list", "at").agg(F.max(F.struct("n", "segment")).alias("s"))
    by_place = longest.groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("at", "s"))).alias("at"))
    df = names.join(by_place, "list", "left")
    # Left to right: a place is a start unless a part that was taken covers it.
    start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<struct<at:int,n:int,known:boolean>>)").alias("parts"))

    def step(acc: Column, i: Column) -> Column:
        size = F.coalesce(F.try_element_at("at", i)["n"], F.lit(1))
        part = F.struct(i.alias("at"), size.alias("n"), (size > 1).alias("known"))
        return F.when(i < acc["next"], acc).otherwise(F.struct((i + size).alias("next"), F.concat(acc["parts"], F.array(part)).alias("parts")))

    parts = F.aggregate(F.sequence(F.lit(1), F.size("names")), start, step, lambda a: a["parts"])
    out = df.select("list", "names", F.col("at").alias("found"), F.explode(parts).alias("p"))
    spelled = F.when(F.col("p.known"), F.try_element_at("found", F.col("p.at"))["segment"]).otherwise(F.expr("slice(names, p.at, 1)"))
    return out.select("list", F.col("p.at").alias("at"), spelled.alias("part"), F.col("p.known").alias("known"))
