"""Titles, names, publishers and URLs, as Column functions and Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

def corrupt(text: Column) -> Column:
    return text.rlike(r"\?{2,}")


def series_name(title: Column) -> Column:
    """The bracketed or colon-led series suffix of a store title, or null."""
    return F.nullif(F.regexp_extract(title, r"[\[(]([^\])]+)[\])]\s*$", 1), F.lit(""))


def without_series(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*[\[(][^\])]+[\])]\s*$", ""))


def canonical_publisher(name: Column) -> Column:
    """Case, spacing and legal forms aside: one spelling for one house. Runs before the identity hash."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"\s+(inc|ltd|llc|co)\.?$", "")
    return F.regexp_replace(bare, r"\s+", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_allowed(url: Column, allowed: Column) -> Column:
    """Whether an http(s) URL's host is one of `allowed` or below one."""
    host = host_of(url)
    return F.startswith(F.lower(url), F.lit("http")) & F.exists(allowed, lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


#: (name, host pattern, URL pattern whose first group is the external id), first fit wins.
ADAPTERS = (
    ("numbered_page", r"\.example\.(com|net|org)$", r"/(?:[a-z]{2})/([0-9]+)(?:[/.?#]|$)"),
    ("item_path", r".", r"/items?/([A-Za-z0-9_-]+)"),
    ("query_id", r".", r"[?&](?:id|item)=([A-Za-z0-9_-]+)"),
)


def external_id(url: Column, adapters=ADAPTERS) -> Column:
    host, found = host_of(url), []
    for _, h, p in adapters:
        found.append(F.when(host.rlike(h), F.nullif(F.regexp_extract(url, p, 1), F.lit(""))))
    return F.coalesce(*found)


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, without fragment, tracking parameters and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"[?&](utm_[a-z]+|ref|fbclid)=[^&]*", "")
    head = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*", 0))
    rest = F.substr(bare, F.length(head) + 1)
    return F.concat(head, F.regexp_replace(rest, r"/+$", ""))


def https_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https://[^/\s]+/\S*$"), F.lit(False))


def media_approved(scope: Column, reviewed: Column, page: Column, original: Column, storage: Column, licence: Column, copy_ok: Column) -> Column:
    """A reviewed display or copy grant, four https addresses, and a copy only where copying is granted."""
    return (
        scope.isin("display", "copy") & reviewed & https_url(page) & https_url(original) & https_url(storage) & https_url(licence)
        & (copy_ok | (original == storage))
    )


def split_list(text: Column) -> Column:
    """Trimmed, non-empty members of a comma-separated column."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _key(t: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKC", t).casefold() if ch.isalnum())


def _spaced(t: str) -> str:
    return "".join(unicodedata.normalize("NFKC", t).lower().split())


def _width(t: str) -> int:
    return len(t) if t.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)


#: Rows of texts that are Python objects at once.
SLICE = 100


def name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, spaced and width of rows (doc_id, text), a slice at a time: a batch of long texts is never a batch of Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            own = b.slice(i, SLICE)
            text = own.column(1).to_pylist()
            of = lambda f, kind, none=None: pa.array([none if t is None else f(t) for t in text], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([own.column(0), of(_key, pa.string()), of(_spaced, pa.string()), of(_width, pa.int32(), 0)], names=["doc_id", "key", "spaced", "width"])


@F.pandas_udf(StringType())
def nfkc_key(text: pd.Series) -> pd.Series:
    """Compatibility form, case-folded, letters and digits only: keys that join differently typed names."""
    return text.map(_key, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_spaced(text: pd.Series) -> pd.Series:
    """Compatibility form, lower-cased, without white space: the search variant keeps punctuation."""
    return text.map(_spaced, na_action="ignore")


@F.pandas_udf(IntegerType())
def display_width(text: pd.Series) -> pd.Series:
    """Columns a text takes: two for wide and full-width characters."""
    return text.map(_width, na_action="ignore").fillna(0).astype("int32")
