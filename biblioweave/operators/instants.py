"""Written days and clock times to instants in UTC, by an as-of join with intervals of zone offsets.

Parsing gives a local time. The offset of a zone is constant between two of its transitions; each such interval, told
in local time and exploded by month, is one row. Joined on (zone, month) with a range condition, two matching intervals
mean that the local time is ambiguous (a clock set back), none that it doesn't exist (a clock set forward), one
gives the offset directly.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.clock import instant_of_number, parts_of_cells, tidy, with_clock, with_days
from biblioweave.session import BROADCAST_BYTES

#: Years that the intervals cover; local times outside have a status of their own, ``beyond``.
YEARS = (1970, 2060)
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
#: Proven bound: the zone database has fewer names than this, each with one row a month and four more a year.
_MOST_ZONES, _ROW_BYTES = 700, 48


def _intervals(zone: str) -> list[tuple[str, int, int, int]]:
    """(zone, first local second, last local second + 1, offset seconds) of every interval in YEARS; none for an unknown zone."""
    import zoneinfo

    try:
        info = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return []
    at = lambda s: int((_EPOCH + dt.timedelta(seconds=s)).astimezone(info).utcoffset().total_seconds())
    first, last = (int((dt.datetime(y, 1, 1, tzinfo=dt.UTC) - _EPOCH).total_seconds()) for y in YEARS)
    out, begin, offset, step = [], first, at(first), 10 * 86400
    for s in range(first, last, step):
        lo, hi = s, min(s + step, last)
        if at(hi) == offset:
            continue
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if at(mid) == offset else (lo, mid)
        out.append((zone, begin + offset, hi + offset, offset))
        begin, offset = hi, at(hi)
    return [*out, (zone, begin + offset, last + offset, offset)]


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(zone_, month_, from_, to_, offset_) for the names in the one column of ``zones``; null and unknown names give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for z in b["zone_"] for r in _intervals(z)]
            yield pd.DataFrame(rows, columns=["zone_", "from_", "to_", "offset_"])

    names = zones.toDF("zone_").where("zone_ is not null").distinct()
    spans = names.mapInPandas(run, "zone_ string, from_ long, to_ long, offset_ int")
    month = lambda c: F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")), "month").cast("date")
    return spans.withColumn("month_", F.explode(F.sequence(month(F.col("from_")), month(F.col("to_") - 1), F.expr("interval 1 month"))))


def as_of(local: DataFrame, intervals: DataFrame, zone: str, seconds: str) -> DataFrame:
    """``local`` with (n_, offset_): how many offsets of ``zone`` its local second has, and the first of them.

    n_ is 1 where the offset is clear, 2 where the local time comes twice (the earlier instant is meant), 0 where it is
    skipped or the zone is null or unknown. Rows keep their number; a zone that holds most rows stays spread out, as the
    intervals go to the rows and not the rows to the intervals.
    """
    fits = _MOST_ZONES * (YEARS[1] - YEARS[0]) * 16 * _ROW_BYTES <= BROADCAST_BYTES
    right = F.broadcast(intervals) if fits else intervals
    # every (zone, month) becomes one row with its few intervals, so that the join keeps the rows of the left side
    packed = right.groupBy("zone_", "month_").agg(F.array_sort(F.collect_list(F.struct("from_", "to_", "offset_"))).alias("spans_"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(seconds) / 86400).cast("int"))
    left = local.withColumn("month_of_", F.trunc(day, "month"))
    joined = left.join(F.broadcast(packed) if fits else packed, (F.col(zone) == F.col("zone_")) & (F.col("month_of_") == F.col("month_")), "left")
    hits = F.filter("spans_", lambda s: (F.col(seconds) >= s["from_"]) & (F.col(seconds) < s["to_"]))
    # the larger offset is the earlier instant
    return joined.withColumn("hits_", F.coalesce(hits, F.array())).withColumns({"n_": F.size("hits_"), "offset_": F.array_max(F.transform("hits_", lambda s: s["offset_"]))}).drop("zone_", "month_", "month_of_", "spans_", "hits_")


def instants(rows: DataFrame, conferences: DataFrame, key: str, day: str = "scheduled_date", time: str = "scheduled_time") -> DataFrame:
    """(``key``, local_start, offset_minutes, utc_start, status) of every row of ``rows``.

    ``rows`` needs venue and year beside the cells, ``conferences`` (venue, year, start_date, end_date, timezone).
    A written zone or offset counts before the conference's. Of two readings of a day the one within the conference
    wins, or one day off if the time is written for another zone. status is ``clear``, ``ambiguous`` (the earlier
    instant is given), ``nonexistent``, ``beyond`` (outside YEARS), ``no day``, ``no time`` or ``no zone``; utc_start is null but for
    the first two.
    Null, empty and unreadable cells are no day and no time; rows without a conference use no zone of one. Every row gives one row.
    """
    c = lambda n: F.col(f"`{n}`")
    d_text, t_text = parts_of_cells(c(day), c(time))
    base = rows.select(c(key).alias("k_"), c("venue").alias("v_"), c("year").cast("int").alias("y_"), c(day).alias("dc_"), c(time).alias("tc_"), d_text.alias("d_"), t_text.alias("t_"))
    conf = conferences.groupBy(F.col("venue").alias("cv_"), F.col("year").cast("int").alias("cy_")).agg(
        F.min("start_date").alias("s_"), F.max("end_date").alias("e_"), F.min("timezone").alias("ctz_")
    )
    base = base.join(conf, (F.col("v_") == F.col("cv_")) & (F.col("y_") == F.col("cy_")), "left")
    number = F.coalesce(instant_of_number(tidy(F.col("tc_"))), instant_of_number(tidy(F.col("dc_"))))
    base = with_clock(with_days(base.withColumn("num_", number), "d_", "y_", "days_"), "t_", "c_")
    written = F.col("c_.offset").isNotNull() | F.col("c_.zone").isNotNull()
    inside = F.filter("days_", lambda x: (x >= F.col("s_")) & (x <= F.col("e_")))
    near = F.filter("days_", lambda x: (x >= F.date_sub("s_", 1)) & (x <= F.date_add("e_", 1)))
    chosen = F.coalesce(F.get(inside, F.lit(0)), F.when(written, F.get(near, F.lit(0))), F.get(near, F.lit(0)), F.get("days_", F.lit(0)))
    base = base.withColumns({"day_": chosen, "tz_": F.when(F.col("c_.offset").isNull(), F.coalesce("c_.zone", "ctz_"))})
    base = base.withColumn("local_", F.when(F.col("c_.ok") & F.col("num_").isNull(), F.datediff("day_", F.lit("1970-01-01")).cast("long") * 86400 + F.col("c_.seconds")))
    named = F.regexp_extract(F.concat_ws(" ", c(day), c(time)), "([A-Z][A-Za-z_]+/[A-Za-z_/]+)", 1)
    zones = conferences.select("timezone").union(rows.where(named != "").select(named).distinct())
    found = as_of(base, zone_intervals(zones), "tz_", "local_")
    offset = F.when(F.col("num_").isNotNull(), F.lit(0)).otherwise(F.coalesce(F.col("c_.offset") * 60, F.col("offset_")))
    utc = F.coalesce("num_", F.col("local_") - offset)
    status = (
        F.when(F.col("num_").isNotNull(), "clear").when(F.col("day_").isNull(), "no day").when(~F.col("c_.ok"), "no time")
        .when(F.col("c_.offset").isNotNull() | (F.col("n_") == 1), "clear").when(F.col("n_") > 1, "ambiguous").when(F.col("tz_").isNull(), "no zone")
        .when(~F.year("day_").between(YEARS[0], YEARS[1] - 1), "beyond").otherwise("nonexistent")
    )
    text = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    return found.select(F.col("k_").alias(key), text(F.col("local_")).alias("local_start"), (offset / 60).cast("int").alias("offset_minutes"), text(utc).alias("utc_start"), status.alias("status"))
