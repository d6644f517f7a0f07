"""Deterministic identities: hashes of natural keys, so no sequence is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def wide_trim(c: Column) -> Column:
    """Trims all white space, the ideographic space included; plain trim() takes ASCII spaces only."""
    return F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")


def slug(kind: str, name: Column) -> Column:
    """Directory slug: kind and digest of the trimmed, lower-cased name."""
    return F.concat(F.lit(f"{kind}-"), F.sha2(F.lower(F.trim(name)).cast("binary"), 256))


def keyed(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first `length` hex digits of the digest of NUL-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(NUL, *parts).cast("binary"), 256), 1, length))


def listing_id(source: Column, external: Column) -> Column:
    return keyed("listing-", 32, source, external)


def observation_id(source: Column, observation: Column, job: Column, external: Column) -> Column:
    """The source's own observation id where it has one, else job and external id."""
    own = F.nullif(F.trim(observation), F.lit(""))
    return keyed("observation-", 40, source, F.coalesce(own, F.concat_ws(NUL, job, external)))


def change_key(*parts: Column) -> Column:
    """Key of an observation's visible state: unchanged offers get the same one."""
    return keyed("", 40, *parts)


def record_digest(*columns: str) -> Column:
    """Digest of a record's sorted columns, for comparing it with a checkpoint."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)
