"""Dates, clock times and zones as people write them, parsed by Catalyst expressions.

Parsing goes in steps of several projections: each step reads the columns of the one before, so that no expression
grows beyond what one generated method may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations, minutes east of UTC (fixed values; IST and CST in the sense of Kolkata and Chicago).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: First three letters of month names in a few languages (fixed values).
MONTHS = {
    "jan": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "déc": 12,
}
#: Days between 1970-01-01 and day 0 of spreadsheet day numbers (1899-12-30).
SHEET_EPOCH = -25569
#: Longest range of clock times, in minutes; anything longer after a bare hyphen is an offset.
LONGEST_RANGE = 60
_ISO_DAY = "\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}"


def tidy(c: Column) -> Column:
    """``c`` with odd blanks made plain, runs of blanks made one and none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, "\u2212\u2010\u2011", "---"), "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+", " "))


def instant_of_number(c: Column) -> Column:
    """Seconds since 1970 of a cell that is a Unix time in seconds or milliseconds, else null."""
    return F.when(c.rlike("^\\d{9,10}$"), c.try_cast("long")).when(c.rlike("^\\d{12,13}$"), F.floor(c.try_cast("long") / 1000))


_SEP = "\u0001"
_WORD = "(?:\\p{L}+\\.?,? )?"
#: Notations of a day: pattern, and the readings as group numbers (year, month, day), likeliest first; 0 is no year.
_NOTATIONS = (
    ("^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})(?:[T ].*)?$", ((1, 2, 3),)),
    ("^((?:19|20)\\d\\d)(\\d\\d)(\\d\\d)$", ((1, 2, 3),)),
    ("^(\\d{1,2})[-./](\\d{1,2})[-./](\\d{4})$", ((3, 2, 1), (3, 1, 2))),
    ("^(\\d{1,2})[-./](\\d{1,2})[-./](\\d{2})$", ((3, 2, 1), (3, 1, 2), (1, 2, 3))),
    (f"^{_WORD}(\\d{{1,2}})(?:st|nd|rd|th|\\.)?[- ](\\p{{L}}{{3,}})\\.?,?[- ](\\d{{2,4}})$", ((3, 2, 1),)),
    (f"^{_WORD}(\\p{{L}}{{3,}})\\.? (\\d{{1,2}})(?:st|nd|rd|th)?,? (\\d{{4}})$", ((3, 1, 2),)),
    (f"^{_WORD}(\\d{{1,2}})(?:st|nd|rd|th|\\.)?[- ](\\p{{L}}{{3,}})\\.?$", ((0, 2, 1),)),
    (f"^{_WORD}(\\p{{L}}{{3,}})\\.? (\\d{{1,2}})(?:st|nd|rd|th)?$", ((0, 1, 2),)),
)


def _groups(c: Column, pattern: str, order: tuple[int, ...]) -> Column:
    """The groups of a pattern that matches the whole cell, in this order, parted by a control character."""
    return F.regexp_replace(c, pattern, _SEP.join(f"${k}" if k else "" for k in order))


def with_days(df: DataFrame, text: str, year: str, out: str) -> DataFrame:
    """``df`` with ``out``: array of the dates that the column ``text`` may mean, likeliest first; empty if it states no day.

    Several only where day and month (or day and year of two digits) may be swapped. A day without a year is of the
    column ``year``; a year of two digits is taken in the century that puts it nearest to it.
    """
    c, near = F.col(text), F.coalesce(F.col(year), F.lit(2000))
    found = F.when(c.rlike(_NOTATIONS[0][0]), F.array(_groups(c, _NOTATIONS[0][0], _NOTATIONS[0][1][0])))
    for pattern, readings in _NOTATIONS[1:]:
        found = found.when(c.rlike(pattern), F.array(*[_groups(c, pattern, r) for r in readings]))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def day(x: Column) -> Column:
        g = F.split(x, _SEP, -1)
        y, m = F.get(g, F.lit(0)), F.get(g, F.lit(1))
        number = y.try_cast("int")
        full = F.when(y == "", near).when(F.length(y) == 2, (F.floor((near - number + 50) / 100) * 100 + number).cast("int")).otherwise(number)
        month = F.coalesce(m.try_cast("int"), F.try_element_at(months, F.substring(F.lower(m), 1, 3)))
        return F.try_to_date(F.concat_ws("-", full.cast("string"), month.cast("string"), F.get(g, F.lit(2))), "y-M-d")

    sheet = F.when(c.rlike("^[1-9]\\d{4}$"), F.array(F.date_add(F.lit("1970-01-01").cast("date"), c.try_cast("int") + SHEET_EPOCH)))
    df = df.withColumn(out, F.coalesce(found, F.array().cast("array<string>")))
    dates = F.array_distinct(F.filter(F.transform(out, day), lambda x: x.isNotNull()))
    return df.withColumn(out, F.coalesce(sheet, dates))


#: hour, minute, second, half of the day, rest
_CLOCK = "(?i)^(\\d{1,2})[:.h](\\d{2})(?:[:.](\\d{2})(?:[.,]\\d+)?)?(?!\\d)(?: ?([ap])\\.? ?m\\b\\.?)?(?: ?(?:uhr|h|hrs)\\b\\.?)?(.*)$"
_HOUR = "(?i)^(\\d{1,2})() ?()([ap])\\.? ?m\\b\\.?(.*)$"
_PACKED = "^([01]\\d|2[0-3])([0-5]\\d)()()((?: .*|Z|[+].*)?)$"
#: hour, minute, half of the day, rest
_RANGE = "(?i)^ ?(?:-|–|—|to|bis) ?(\\d{1,2})[:.h](\\d{2})(?:[:.]\\d{2})? ?(?:([ap])\\.?m\\.?)? ?((?:[^\\d].*)?)$"
_OFFSET = "(?i)^(?:UTC|GMT)? ?([+-])(\\d{1,2})(?::?(\\d{2}))?$"


def _half(hour: Column, half: Column) -> Column:
    """The hour of 24 from an hour of 12 with its half of the day."""
    return F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), F.lit(0)).otherwise(hour)


def with_clock(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the struct ``out`` (seconds int, offset minutes or null, zone name or null, ok boolean) of clock times.

    A range counts as its start. After a bare hyphen a second time is the end of a range only if that is later by
    LONGEST_RANGE minutes at most, else an offset from UTC. Words for a part of the day are no clock time: ok is false.
    """
    c, kept = F.col(text), df.columns
    at = lambda a, k: F.get(F.col(a), F.lit(k))
    number = lambda x: x.try_cast("int")
    five = F.when(c.rlike(_CLOCK), _groups(c, _CLOCK, (1, 2, 3, 4, 5))).when(c.rlike(_HOUR), _groups(c, _HOUR, (1, 2, 3, 4, 5))).when(c.rlike(_PACKED), _groups(c, _PACKED, (1, 2, 3, 4, 5)))
    df = df.withColumn("g_", F.split(five, _SEP, -1))
    df = df.withColumns({"half_": F.lower(at("g_", 3)), "hh_": number(at("g_", 0)), "m_": F.coalesce(number(at("g_", 1)), F.lit(0)), "sec_": F.coalesce(number(at("g_", 2)), F.lit(0)), "rest_": at("g_", 4)})
    df = df.withColumns({"h_": _half(F.col("hh_"), F.col("half_")), "r_": F.split(F.when(F.col("rest_").rlike(_RANGE), _groups(F.col("rest_"), _RANGE, (1, 2, 3, 4))), _SEP, -1)})
    df = df.withColumn("longer_", _half(number(at("r_", 0)), F.lower(at("r_", 2))) * 60 + number(at("r_", 1)) - F.col("h_") * 60 - F.col("m_"))
    longer, offset_like = F.col("longer_"), F.col("rest_").rlike("^ ?-\\d\\d:?\\d\\d$")
    wrapped = F.when(longer <= 0, longer + 24 * 60).otherwise(longer)
    ranged = F.when(offset_like, (longer > 0) & (longer <= LONGEST_RANGE) & ~F.col("rest_").startswith(" ")).otherwise(wrapped <= LONGEST_RANGE)
    df = df.withColumn("zone_text_", F.trim(F.regexp_replace(F.when(F.coalesce(ranged, F.lit(False)), at("r_", 3)).otherwise(F.col("rest_")), "[()\\[\\],]", " ")))
    zone = F.col("zone_text_")
    df = df.withColumn("o_", F.split(F.when(zone.rlike(_OFFSET), _groups(zone, _OFFSET, (1, 2, 3))), _SEP, -1))
    minutes = number(at("o_", 1)) * 60 + F.coalesce(number(at("o_", 2)), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    df = df.withColumn("offset_min_", F.coalesce(F.when(at("o_", 0) == "-", -minutes).otherwise(minutes), F.try_element_at(table, F.upper(zone))))
    named = F.when(zone.rlike("^[A-Z][A-Za-z_]+/[A-Za-z_/]+$"), zone)
    good = (F.col("h_") < 24) & (F.col("m_") < 60) & (F.col("sec_") < 60) & ((F.col("half_") == "") | F.col("hh_").between(1, 12))
    ok = good & ((zone == "") | F.col("offset_min_").isNotNull() | named.isNotNull())
    made = F.struct((F.col("h_") * 3600 + F.col("m_") * 60 + F.col("sec_")).alias("seconds"), F.col("offset_min_").alias("offset"), named.alias("zone"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return df.select(*[F.col(f"`{k}`") for k in kept], made.alias(out))


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, pattern, k)


def parts_of_cells(day_cell: Column, time_cell: Column) -> tuple[Column, Column]:
    """The text that states the day and the text that states the clock time; a full date and time may stand in either cell.

    Midnight in a cell that otherwise holds only a date is no clock time.
    """
    d, t = tidy(F.coalesce(day_cell, F.lit(""))), tidy(F.coalesce(time_cell, F.lit("")))
    full = f"^({_ISO_DAY})[T ](\\d.*)$"
    bare = d.rlike(f"^{_ISO_DAY}[T ]0?0[:.]00(?:[:.]00(?:\\.0+)?)?$")
    day = F.when(t.rlike(full), _part(t, full, 1)).when(d.rlike(full), _part(d, full, 1)).otherwise(d)
    time = F.when(t.rlike(full), _part(t, full, 2)).when(t != "", t).when(d.rlike(full) & ~bare, _part(d, full, 2)).otherwise(F.lit(""))
    return day, time
