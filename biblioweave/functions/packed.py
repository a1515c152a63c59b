"""Cells that hold several values: quote-aware splitting as Catalyst expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a delimiter outside quotes while a cell is folded; a control character, removed from the input first.
MARK = "\u0001"
#: White space trimmed from values; odd blanks of the text count as blanks.
BLANKS = "[\\s\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]"


def strip(c: Column) -> Column:
    """``c`` without blanks at its ends, line breaks and odd blanks included."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def pieces(cell: Column) -> Column:
    """The cell cut at its quote characters: even positions lie outside quotes, odd ones inside.

    A cell whose quotes don't pair up has one piece: its quote characters are ordinary text.
    """
    parts = F.split(F.regexp_replace(cell, MARK, " "), '"', -1)
    return F.when(F.size(parts) % 2 == 1, parts).otherwise(F.array(F.regexp_replace(cell, MARK, " ")))


def outside(parts: Column) -> Column:
    """The text outside quotes, from ``pieces``."""
    return F.concat_ws(" ", F.filter(parts, lambda _, i: i % 2 == 0))


def fold(parts: Column, delimiter: Column | str) -> Column:
    """The values of a cell in order, empty places included, from ``pieces`` and a regex for delimiters.

    Odd pieces are literals; in even ones each delimiter becomes a mark; an empty even piece between two literals
    was a doubled quote. One array fold joins the pieces again, one split yields the values.
    """
    pattern = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    last = F.size(parts) - 1
    marked = F.transform(
        parts,
        lambda x, i: F.when(i % 2 == 1, x)
        .when((i > 0) & (i < last) & (x == ""), F.lit('"'))
        .otherwise(F.regexp_replace(x, pattern, F.lit(MARK))),
    )
    joined = F.aggregate(marked, F.lit(""), lambda acc, x: F.concat(acc, x))
    return F.split(joined, MARK, -1)


def csv_fields(record: Column) -> Column:
    """The fields of one CSV record (RFC 4180: commas, doubled quotes, quoted line breaks); null for null."""
    bare = F.regexp_replace(record, "[\\r\\n]+$", "")
    return F.when(bare.contains('"'), fold(pieces(bare), ",")).otherwise(F.split(bare, ",", -1))
