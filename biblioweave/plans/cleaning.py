"""Queries of the general cleaning operators (written times, packed cells, drifting files) over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.operators import drift, instants, packed
from biblioweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_instants(spark: SparkSession, base: str) -> DataFrame:
    """Start of every workshop row and talk: local time, offset, instant in UTC and how clear it is."""
    conferences = table(spark, base, "conferences", "venue", "year", "start_date", "end_date", "timezone")
    cells = ("venue", "year", "scheduled_date", "scheduled_time")
    parts = [table(spark, base, name, key, *cells).select(F.struct(F.lit(name).alias("table_name"), F.col(key).alias("record_id")).alias("id_"), *cells) for name, key in (("workshop", "record_id"), ("talks", "talk_id"))]
    found = instants.instants(parts[0].union(parts[1]), conferences, "id_")
    return found.select("id_.table_name", "id_.record_id", "local_start", "offset_minutes", "utc_start", "status")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The one instant in UTC of every row whose day, clock time and zone can be told."""
    return p2_instants(spark, base).where("utc_start is not null").select("table_name", "record_id", "utc_start")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Every value of the packed workshop cells with its place."""
    return packed.unpack(table(spark, base, "workshop", "record_id", *packed.KINDS), "record_id")


def _files(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, base, "source_files", "file_id", "kind", "header_line"), table(spark, base, "raw_rows", "raw_id", "file_id", "record_line"), table(spark, base, "std_fields")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Each deviation of each delivered file from the agreed fields."""
    return drift.changes(*_files(spark, base))


def p4_schema(spark: SparkSession, base: str) -> DataFrame:
    """The tagged union of every agreed field: which types occur, in how many files and values."""
    return drift.fused_schema(*_files(spark, base))


def p4_committees(spark: SparkSession, base: str) -> DataFrame:
    """One consistent table of all committee files."""
    return drift.consistent(*_files(spark, base), "committees").withColumn("extra", F.to_json("extra"))


def p4_talks(spark: SparkSession, base: str) -> DataFrame:
    """One consistent table of all talk files."""
    return drift.consistent(*_files(spark, base), "talks").withColumn("extra", F.to_json("extra"))


def p4_workshop(spark: SparkSession, base: str) -> DataFrame:
    """One consistent table of all workshop files."""
    return drift.consistent(*_files(spark, base), "workshop").withColumn("extra", F.to_json("extra"))


def p4_proceedings(spark: SparkSession, base: str) -> DataFrame:
    """One consistent table of all proceedings files."""
    return drift.consistent(*_files(spark, base), "proceedings").withColumn("extra", F.to_json("extra"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_instants, p3_found, p4_found, p4_schema, p4_committees, p4_talks, p4_workshop, p4_proceedings)}
