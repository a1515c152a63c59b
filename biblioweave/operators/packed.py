"""One row per value of packed cells, position kept.

The cell is cut at quote characters: odd pieces are literals, even pieces are split on the cell's delimiter, and
array folds reassemble the values with their ordinals. Everything is a Catalyst expression; rows never meet, so
there is no shuffle and no skew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.packed import BLANKS, fold, outside, pieces, strip

#: What the values of a field are; decides which weak delimiters (comma, "and") may part them.
KINDS = {"authors": "person", "speakers": "person", "affiliations": "institution", "arxiv_ids": "code"}
#: Strong delimiters: whatever the field, they part values. A line break after a semicolon or bar belongs to it.
STRONG = f"[;；|]{BLANKS}*|\\n|\\t|{BLANKS}/{BLANKS}"
_AND = f"{BLANKS}+(?:and|&|und|et){BLANKS}+"
#: A comma with or without a final "and", or "and" alone.
WEAK = f",{BLANKS}*(?:and|&){BLANKS}+|,|{_AND}"
#: Institutions that are no part of another, by how their names begin or end, to tell a list of institutions from one whose
#: name has a comma (fixed values).
INSTITUTION = (
    "(?i)^(?:the )?(?:univ\\w*|polytechnic|politecnico|technische (?:univ|hochschule)\\w*|(?:national|royal) (?:institute|laboratory|academy)|academy|\\w+ (?:university|polytechnic|academy)"
    "|\\w+ (?:(?:national|research) (?:institute|laborator(?:y|ies))|institute of technology|college)|\\w+ (?:labs?|research|photonics|technologies|systems|instruments|industries)\\b.*|.* (?:inc|ltd|llc|gmbh|corp|ag|s\\.a)\\.?$)"
)
_GIVEN = "^(?:[\\p{Lu}]\\.?[- ]?){1,4}$|^[^\\s,.]+$|^[^\\s,.]+(?: [\\p{Lu}]\\.?)$"


def _one_person(cell: Column) -> Column:
    """Whether a cell without strong delimiters is one person written family name first: ``Family, G.``."""
    parts = F.transform(F.split(cell, ",", -1), strip)
    family, given = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    short = F.size(F.split(given, f"{BLANKS}+")) == 1
    particle = family.rlike("(?i)^(?:(?:van|von|der|den|de|da|di|du|el|la|le)\\b\\.? ?)+")
    simple = (F.size(F.split(family, f"{BLANKS}+")) == 1) | particle
    initials = given.rlike("^(?:\\p{Lu}\\.?[- ]?){1,4}$")
    return (F.size(parts) == 2) & (family != "") & (given != "") & (short | initials | (simple & given.rlike(_GIVEN))) & ~given.rlike(_AND)


def delimiter(cell: Column, parts: Column, out: Column, kind: Column) -> Column:
    """The regex that parts the values of a cell, given its pieces and the text outside quotes; one that matches nothing if it is one value."""
    never, quoted = F.lit("(?!)"), F.size(parts) > 1
    pieces_ = F.transform(F.split(cell, ",", -1), strip)
    several = F.forall(pieces_, lambda x: x.rlike(INSTITUTION)) & (F.size(pieces_) > 1)
    institution = F.when(quoted & out.contains(","), F.lit(",")).when(cell.contains(",") & several, F.lit(",")).otherwise(never)
    person = F.when(~quoted & cell.contains(",") & _one_person(cell), never).otherwise(F.lit(WEAK))
    code = F.when(out.rlike(WEAK), F.lit(WEAK)).otherwise(F.lit(f"{BLANKS}+"))
    return F.when(out.rlike(STRONG), F.lit(STRONG)).when(kind == "institution", institution).when(kind == "person", person).otherwise(code)


def unpack(df: DataFrame, key: str, kinds: Mapping[str, str] = KINDS) -> DataFrame:
    """Rows (``key``, field_name, pos, item) of every value in the columns named in ``kinds``.

    pos starts at 1 and counts empty places between values; an empty place, an empty or a null cell gives no row;
    item is as written, without blanks and quotes around it, doubled quotes undone. Rows with the same key give
    the same number of rows each; other columns, whatever their names, are not read. An empty table gives none.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(k).alias("kind"), F.col(f"`{f}`").alias("cell")) for f, k in kinds.items()])
    cells = df.select(F.col(f"`{key}`").alias("k_"), F.explode(fields).alias("c_")).where(F.col("c_.cell") != "")
    # each step is a projection of its own, so that what several parts of the next one need is worked out once
    bare = F.regexp_replace(F.regexp_replace(F.col("c_.cell"), "\\r\\n?", "\n"), f"(?:[;；|,]|{BLANKS})+$", "")
    cells = cells.select("k_", F.col("c_.f").alias("f_"), F.col("c_.kind").alias("kind_"), bare.alias("cell_")).withColumn("parts_", pieces(F.col("cell_")))
    cells = cells.withColumn("out_", outside(F.col("parts_"))).withColumn("by_", delimiter(F.col("cell_"), F.col("parts_"), F.col("out_"), F.col("kind_")))
    rows = cells.select("k_", "f_", F.posexplode(fold(F.col("parts_"), F.col("by_"))).alias("p_", "x_")).withColumn("x_", strip(F.col("x_")))
    return rows.where(F.col("x_") != "").select(
        F.col("k_").alias(key), F.col("f_").alias("field_name"), (F.col("p_") + 1).cast("int").alias("pos"), F.col("x_").alias("item")
    )
