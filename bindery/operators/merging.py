"""Reviewed merges of works: editions move, credits and names unite, members are superseded, incomplete groups wait."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators.components import components
from bindery.storage import Scratch


@dataclass
class Merged:
    """works, editions and credits after the merges; targets (work_id, into) of the superseded works; groups (group_id, reason) that wait."""

    works: DataFrame
    editions: DataFrame
    credits: DataFrame
    targets: DataFrame
    deferred: DataFrame


def deferred_groups(works: DataFrame, editions: DataFrame, people: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, reason) of the groups that miss something: their work, their person, or a member's edition or work. A member's
    work may be missing if its edition belongs to the group's work already."""
    w = works.select("work_id", F.lit(True).alias("there"))
    g = groups.join(w.withColumnRenamed("there", "has_work"), "work_id", "left").join(people.select("person_id", F.lit(True).alias("has_person")), "person_id", "left")
    g = g.join(w.select(F.col("work_id").alias("member_id"), F.col("there").alias("has_member")), "member_id", "left")
    g = g.join(editions.select("edition_id", F.col("work_id").alias("owner"), F.lit(True).alias("has_edition")), "edition_id", "left")
    # The first of these that is missing.
    why = lambda rank, what: F.struct(F.lit(rank).alias("rank"), F.lit(what).alias("reason"))
    reason = (
        F.when(F.col("has_work").isNull(), why(0, "work")).when(F.col("has_person").isNull(), why(1, "person")).when(F.col("has_edition").isNull(), why(2, "edition"))
        .when(F.col("has_member").isNull() & (F.col("owner") != F.col("work_id")), why(3, "member"))
    )
    return g.groupBy("group_id").agg(F.min(reason).alias("r")).where("r IS NOT NULL").select("group_id", "r.reason")


def merge_targets(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(work_id, into) for links (member_id, work_id): chains are followed to the work that is no member itself. Of several such works
    in one component, and in a ring that has none, the smallest is meant."""
    all_ = components(scratch, links.select(F.col("member_id").alias("a"), F.col("work_id").alias("b")))
    members = links.where("member_id <> work_id").select(F.col("member_id").alias("node"), F.lit(True).alias("member")).distinct()
    marked = all_.join(members, "node", "left")
    end = marked.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("member").isNull(), F.col("node"))), F.min("node")).alias("into"))
    return all_.join(end, "root").where("node <> into").select(F.col("node").alias("work_id"), "into")


def merge_works(spark: SparkSession, works: DataFrame, editions: DataFrame, credits: DataFrame, people: DataFrame, groups: DataFrame) -> Merged:
    """Carries out reviewed `groups` (group_id, work_id, person_id, member_id, edition_id), all members of a group or none.

    works: work_id, status, featured_names (array); editions: edition_id, work_id; credits: work_id, person_id, role.
    Names keep the order of the canonical work's list, then of the members by work_id; each counts once.
    """
    scratch = Scratch(spark)
    deferred = scratch.put(deferred_groups(works, editions, people, groups), "deferred")
    ready = groups.join(deferred, "group_id", "left_anti")
    targets = scratch.put(merge_targets(scratch, ready), "targets")
    move = lambda df: df.join(targets, "work_id", "left").withColumn("work_id", F.coalesce("into", "work_id")).drop("into")
    joined = works.join(targets, "work_id", "left")
    place = F.struct((F.col("into").isNotNull()).cast("int").alias("k"), "work_id", F.col("at"))
    names = joined.select("work_id", "into", F.posexplode("featured_names").alias("at", "name")).select(F.coalesce("into", "work_id").alias("work_id"), place.alias("p"), "name")
    first = names.groupBy("work_id", "name").agg(F.min("p").alias("p"))
    united = first.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"]).alias("united"))
    after = joined.join(united, "work_id", "left").withColumns({
        "status": F.when(F.col("into").isNotNull(), "superseded").otherwise(F.col("status")),
        "featured_names": F.when(F.col("into").isNull(), F.coalesce("united", "featured_names")).otherwise(F.col("featured_names")),
    })
    return Merged(after.drop("into", "united").select(*works.columns), move(editions).select(*editions.columns), move(credits).select(*credits.columns).distinct(), targets, deferred)
