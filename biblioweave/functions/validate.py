"""Checks that tables with constraints would make, as boolean columns; null values pass unless a key is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of the kinds of text and of metadata (fixed values).
BYTES = {"name": 255, "title": 1000, "abstract": 50_000, "url": 2048, "metadata": 4096}
#: Values of the enumerations in their order, which is the order to sort by (fixed values).
PAPER_TYPES = ("regular", "poster", "invited", "tutorial", "keynote", "plenary", "plenary_short", "plenary_long", "industry")
COMMITTEE_TYPES = ("OC", "PC", "SC", "Local")
POSITIONS = ("chair", "co_chair", "area_chair", "member")
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def text_fits(c: Column, kind: str) -> Column:
    """Whether a text has no more bytes than its kind allows."""
    return F.coalesce(F.octet_length(c) <= BYTES[kind], F.lit(True))


def url_ok(c: Column, optional: bool = True) -> Column:
    """Whether a link is of http or https with something after it, and not too long; empty is right where it is optional."""
    good = c.rlike("(?i)^\\s*https?://\\s*\\S") & (F.octet_length(c) <= BYTES["url"])
    return F.coalesce(F.when(F.lit(optional) & (c == ""), F.lit(True)).otherwise(good), F.lit(optional))


def metadata_ok(c: Column) -> Column:
    """Whether a JSON text is an object of allowed size."""
    return c.isNull() | F.coalesce(F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull() & (F.octet_length(c) <= BYTES["metadata"]), F.lit(False))


def orcid_ok(c: Column) -> Column:
    return F.coalesce(c.rlike("^\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX]$"), F.lit(True))


def country_ok(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Z]{2}$"), F.lit(True))


def ordinal(c: Column, values: tuple[str, ...]) -> Column:
    """Place of an enumeration's value in its order; null for null and unknown values."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in enumerate(values) for x in (v, k)]), c)


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page of an ordered result; limit and offset are clamped to 1..1000 (default 100) and 0 or more."""
    n, skip = clamp(limit, offset)
    return df.offset(skip).limit(n)


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Limit and offset within their bounds."""
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MAX_LIMIT), max(offset or 0, 0)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number; null keys are no key."""
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key isn't null and not in ``parent``."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("parent_key_")), F.col(key) == F.col("parent_key_"), "left_anti")
