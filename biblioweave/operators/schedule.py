"""Talks with day and time from the blocks of a programme page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.operators.matching import last_of

#: Letters of a title at least, minutes of a contributed talk, and how far back a paragraph without a time looks for one (fixed values).
LEAST_TITLE, CONTRIBUTED, LOOK_BACK = 15, 20, 2
_TIMED = "^\\d{2}:\\d{2}-\\d{2}:\\d{2}"


def merged_schedule(blocks: DataFrame, day: Column) -> DataFrame:
    """(file_name, title_key, title, day, start, minutes, speaker, is_merged) from paragraphs of contributed sessions.

    blocks: (file_name, pos, kind, text, emphasis). A paragraph that begins with a range of times holds a talk; after one that says
    ``Merge:`` all paragraphs up to the next time have its time; other paragraphs without a time take one that stands
    LOOK_BACK paragraphs before at most. The title is the emphasised text, else what follows the time; shorter ones
    than LEAST_TITLE are none. ``day`` is a heading's text, carried down. A title that comes twice counts as it stands last.
    """
    w = Window.partitionBy("file_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dated = blocks.withColumn("day", F.last(F.when(F.col("kind").rlike("^h[1-6]$"), day), ignorenulls=True).over(w))
    p = dated.where("kind = 'p'").withColumn("n", F.row_number().over(Window.partitionBy("file_name").orderBy("pos")))
    timed = F.col("text").rlike(_TIMED)
    mark = F.when(timed, F.struct(F.substring("text", 1, 5).alias("start"), F.lower("text").contains("merge:").alias("merge"), F.col("n").alias("at")))
    p = p.withColumn("last_", F.last(mark, ignorenulls=True).over(w))
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", f"{_TIMED}\\s*", ""), "(?i)^merge:\\s*", ""))
    bold = F.trim(F.regexp_replace(F.coalesce("emphasis", F.lit("")), "(?i)^merge:?\\s*", ""))
    title = F.when(bold != "", bold).otherwise(bare)
    near = F.col("n") - F.col("last_.at") <= LOOK_BACK
    kept = p.withColumn("title", title).where(F.col("last_").isNotNull() & (timed | F.col("last_.merge") | near) & (F.length("title") >= LEAST_TITLE))
    after = F.trim(F.regexp_replace(F.substring(bare, F.length("title") + 1, F.lit(10_000)), "^[\\s,:–—-]+", ""))
    speaker = F.trim(F.substring_index(F.when(bare.startswith(F.col("title")), after).otherwise(""), ",", 1))
    rows = kept.select("file_name", "pos", N.title_folded(F.col("title")).alias("title_key"), "title", "day", F.col("last_.start").alias("start"), F.lit(CONTRIBUTED).alias("minutes"), speaker.alias("speaker"), (~timed | F.col("last_.merge")).alias("is_merged"))
    return last_of(rows.withColumn("slot_", F.concat_ws("|", "file_name", "title_key")), "slot_", "pos").drop("slot_", "pos")


def timetable(blocks: DataFrame, start: Column) -> DataFrame:
    """(file_name, pos, date, start, minutes, title, paper_type) of paragraphs and cells that begin with a range of times.

    The weekday in the last heading gives the date, counted from ``start``. Items that are no talks are left out unless part of
    them is emphasised; the type comes from words and, without any, from the length.
    """
    w = Window.partitionBy("file_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("kind").rlike("^h[1-6]$")
    rows = blocks.withColumn("date", F.last(F.when(head, X.day_of_conference(F.col("text"), start)), ignorenulls=True).over(w)).where(~head)
    span = "^\\s*\\d{1,2}[:.]\\d{2}\\s*[-–]\\s*\\d{1,2}[:.]\\d{2}\\s*"
    rows = rows.where(F.col("text").rlike(span)).withColumn("r", X.time_range(F.col("text"))).withColumn("title", F.trim(F.regexp_replace("text", span, "")))
    talk = X.is_talk(F.col("title")) | (F.coalesce(F.col("emphasis"), F.lit("")) != "")
    return rows.where(talk & (F.col("title") != "")).select("file_name", "pos", "date", "r.start", "r.minutes", "title", X.paper_type_timed(F.col("title"), F.col("r.minutes")).alias("paper_type"))
