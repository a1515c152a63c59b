"""Files whose fields were added, renamed, removed or changed type, read into one table per kind, each change reported.

Tagged-union inference: every value gets a tag (integer, date, time or text) and a few more marks of its shape; the tags of
a column are its alternative types, and fusing the columns of parallel files keeps all alternatives of a field instead
of widening them to text. The fused marks of a field also tell which column stands for it where the header doesn't: the
marks in common, the place among the agreed fields and the words of the header are votes, and a known other name is one
more. A conflicting field is split into typed branches beside its canonical conversion, and the alternatives that
appear against the agreed type are the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions.clock import tidy, with_clock, with_days
from biblioweave.functions.packed import csv_fields, strip
from biblioweave.session import broadcast_if_small, cut

#: Other names under which an agreed field is delivered, in lower case with "_" for anything but letters and digits (fixed values).
ALIASES = {
    "venue": ("conference", "conf", "series"),
    "year": ("yr", "edition_year"),
    "committee_type": ("committee", "committee_name", "type"),
    "position": ("pos", "rank", "member_position"),
    "full_name": ("name", "member", "member_name", "person", "fullname", "committee_member"),
    "affiliation": ("affiliations", "institution", "inst", "institute", "organisation", "organization", "org", "affil", "member_affiliation"),
    "role_title": ("role", "title", "function", "role_name"),
    "paper_type": ("type", "talk_type", "category", "contribution_type", "kind"),
    "title": ("paper_title", "talk_title", "paper", "talk"),
    "speakers": ("speaker", "presenter", "presenters", "presented_by", "talk_by", "given_by", "speaker_s"),
    "authors": ("author", "author_s", "author_list", "authors_list", "author_names", "written_by"),
    "affiliations": ("affiliation", "author_affiliations", "author_affiliation", "institutions", "institution", "inst", "affils"),
    "abstract": ("abstracts", "summary", "abstract_text"),
    "arxiv_ids": ("arxiv", "arxiv_id", "arxiv_number", "arxiv_no", "eprint", "eprints", "preprint"),
    "presentation_url": ("slides", "slides_url", "slide_url", "presentation", "slides_link", "presentation_link"),
    "video_url": ("video", "video_link", "recording", "recording_url", "recording_link"),
    "youtube_id": ("youtube", "yt_id", "yt", "youtube_video"),
    "session_name": ("session", "track_session", "session_title", "track"),
    "award": ("awards", "prize", "honour"),
    "notes": ("note", "remarks", "remark", "comment", "comments"),
    "scheduled_date": ("date", "day", "talk_date", "start_date", "sched_date"),
    "scheduled_time": ("time", "start", "start_time", "talk_time", "begin", "sched_time"),
    "duration_minutes": ("duration", "dur", "minutes", "mins", "min", "length", "length_min", "length_minutes", "duration_min"),
}
#: Votes that a column stands for a field: a known other name, the field's words in the header (by their share), the field's
#: place; the share of marks in common counts as it is. Votes of ENOUGH make it stand for the field.
ALIAS, WORD, PLACE, ENOUGH = 1.2, 0.4, 0.5, 1.0
#: Values that a mark of each sort may have: bounds what a column's marks take up, however many values it has.
_MARKS = 4096
#: Patterns of the types; whatever fits none is text.
TYPES = {"integer": "^\\d+$", "date": "^\\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01])$", "time": "^(?:[01]?\\d|2[0-3]):[0-5]\\d(?::[0-5]\\d)?$"}


def tag(value: Column) -> Column:
    """The type of a stripped value: null if it is empty, else integer, date, time or text."""
    # every type but text begins with a digit
    out = F.when(value == "", F.lit(None).cast("string")).when(~F.substring(value, 1, 1).between("0", "9"), "text")
    for name, pattern in TYPES.items():
        out = out.when(value.rlike(pattern), F.lit(name))
    return out.otherwise(F.when(value.isNotNull(), F.lit("text")))


def _plain(header: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(header), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")


def _fields(std: DataFrame) -> DataFrame:
    """(sk, field, pos, code, types): the agreed fields of every kind, numbered over all kinds."""
    each = std.groupBy(F.col("kind").alias("sk"), F.col("field_name").alias("field")).agg(F.min("pos").alias("pos"), F.collect_set("data_type").alias("types"))
    return each.withColumn("code", F.row_number().over(Window.orderBy("sk", "field")) - 1)


def _layout(files: DataFrame, agreed: DataFrame) -> DataFrame:
    """(file_id, kind, heads_, fields_, slots_): a row for each file, from its header alone.

    heads_ are the columns (header, plain); fields_ the agreed fields of the kind, each with the index ``idx`` of the leftmost column
    of its own name or -1; slots_ has for each column the field's code where it is that column, -1 where it may stand for a
    missing field, -2 where it stands for nothing. All three are bounded by the header and the kind, never by rows.
    """
    of_kind = agreed.groupBy("sk").agg(F.sort_array(F.collect_list(F.struct("code", "field", "pos", "types"))).alias("f_"))
    none = F.array().cast(of_kind.schema["f_"].dataType)
    header = csv_fields(F.regexp_replace("header_line", "^\\ufeff", ""))
    out = files.select("file_id", "kind", F.coalesce(header, F.array().cast("array<string>")).alias("raw_")).join(F.broadcast(of_kind), F.col("kind") == F.col("sk"), "left")
    out = out.withColumns({"f_": F.coalesce("f_", none), "raw_": F.transform("raw_", strip)})
    out = out.withColumn("heads_", F.transform("raw_", lambda h: F.struct(h.alias("header"), _plain(h).alias("plain"))))
    at = lambda f: F.coalesce(F.array_position(F.col("heads_.plain"), f["field"]), F.lit(0)).cast("int") - 1
    out = out.withColumn("fields_", F.transform("f_", lambda f: F.struct(*[f[c].alias(c) for c in ("code", "field", "pos", "types")], at(f).alias("idx"))))
    own = lambda i: F.get(F.col("fields_.code"), F.array_position(F.col("fields_.idx"), i).cast("int") - 1)
    free = lambda h: F.when((h["header"] != "") & F.array_contains(F.col("fields_.idx"), -1), -1).otherwise(-2)
    slots = F.transform("heads_", lambda h, i: F.coalesce(own(i), free(h)))
    return out.select("file_id", "kind", "heads_", "fields_", slots.alias("slots_"))


def marks(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """(file_, key_, mark, n): how many values bear each mark, of the columns that need it.

    Marks are numbers: the tag, and hashes of the shape of the beginning (words, capitals, digits, signs), of the number of words
    with the separators, and of the first word. All marks of a field's own columns are counted over all files (file_ null, key_ the
    field's code), those of open columns for each file (key_ the index); the tags of all other columns are too (key_ -1 - index).
    Rows meet the layout of their file by merge, as no bytes that follow the files belong in the driver; a file that
    holds most rows may be split by AQE, as counts are combined before their own shuffle.
    """
    cells = rows.select("file_id", "record_line").join(layout.select("file_id", "slots_").hint("merge"), "file_id").select("file_id", "slots_", F.posexplode(csv_fields(F.col("record_line"))).alias("idx", "v"))
    cells = cells.select("file_id", "idx", F.get("slots_", F.col("idx")).alias("slot"), strip(F.col("v")).alias("value")).where("value <> '' and slot is not null")
    v = F.col("value")
    capitals, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shape = F.substring(F.regexp_replace(F.substring(v, 1, 48), "[A-Z]?[a-z]+", "a"), 1, 16)
    shape = F.translate(shape, capitals + digits, "U" * 26 + "9" * 10)
    blanks = F.length(v) - F.length(F.replace(v, F.lit(" ")))
    count = F.concat(F.least(blanks, F.lit(6)).cast("string"), *[F.when(v.contains(c), c).otherwise("") for c in ";,/@"])
    hashed = lambda k, c: F.lit(k * _MARKS) + F.pmod(F.xxhash64(c), F.lit(_MARKS))
    number = F.array_position(F.array(*[F.lit(t) for t in (*TYPES, "text")]), tag(v))
    # a negative mark is the tag once more, for the file
    rest = F.when(F.col("slot") == -2, F.array().cast("array<bigint>")).otherwise(F.array(hashed(1, shape), hashed(2, count), hashed(3, F.substring_index(v, " ", 1))))
    each = cells.select("file_id", "idx", "slot", number.alias("tag_"), rest.alias("rest_"))
    each = each.select("file_id", "idx", "slot", F.explode(F.concat(F.array("tag_"), "rest_", F.when(F.col("slot") >= 0, F.array(-F.col("tag_"))).otherwise(F.array().cast("array<bigint>")))).alias("m"))
    fused = (F.col("slot") >= 0) & (F.col("m") > 0)
    key = F.when(fused, F.col("slot")).when(F.col("slot") == -1, F.col("idx")).otherwise(-1 - F.col("idx"))
    return each.groupBy(F.when(~fused, F.col("file_id")).alias("file_"), key.alias("key_"), F.abs("m").alias("mark")).agg(F.count("*").alias("n"))


def _hits(layout: DataFrame, marked: DataFrame, fields: int) -> DataFrame:
    """(file_h, hits_): for each file with any, the codes of missing fields with the index of the column that stands for each.

    A column's likeness to a field is the share of the field's marks that it has in common with it. The field's marks are those of the
    columns of all files of the kind that bear its own name; of each sort only marks of a hundredth of its values or more
    count, so that a field has at most a few hundred.
    """
    sort = F.floor(F.col("mark") / _MARKS)
    share = lambda *by: F.col("n") / F.sum("n").over(Window.partitionBy(*by, "sort_"))
    # shapes tell most and count twice. Where a field's shapes or first words are few, those of the column must be among them
    sides = {"shape": F.col("sort_") == 1, "word": F.col("sort_") == 3}
    weight = F.when(sides["shape"], 2.0).otherwise(1.0)
    part = lambda k, c: F.coalesce(F.sum(F.when(sides[k], F.col(c))), F.lit(0.0))
    fused = marked.where("file_ is null").withColumn("sort_", sort).withColumn("p_", share("key_")).where("p_ >= 0.01").select(F.col("key_").alias("code"), "mark", "sort_", "p_")
    mass = fused.groupBy("code").agg(F.sum(weight * F.col("p_")).alias("mass_"), *[part(k, "p_").alias(f"{k}_") for k in sides])
    # at most 100 marks of each of three sorts, and the tags, have a hundredth of a field's values
    most = fields * (len(TYPES) + 1 + 3 * 100)
    fused = broadcast_if_small(fused.select("code", "mark", "p_").join(broadcast_if_small(mass, fields, 4 * 48), "code"), most, 6 * 48)
    mine = marked.where("file_ is not null and key_ >= 0").withColumn("sort_", sort).withColumn("q_", share("file_", "key_"))
    pairs = _pairs(layout)
    both = pairs.join(mine.select("file_", "key_", "mark", "sort_", "q_").hint("merge"), (F.col("file_id") == F.col("file_")) & (F.col("idx") == F.col("key_")), "left").join(fused, ["code", "mark"], "left").withColumn("c_", F.when(F.col("p_").isNotNull(), F.least("p_", "q_")))
    each = both.groupBy("file_id", "idx", "code", "field", "votes_").agg((F.sum(weight * F.col("c_")) / F.max("mass_")).alias("like"), *[(F.max(f"{k}_") - part(k, "c_")).alias(f"{k}_gap_") for k in sides])
    gap = sum((0.5 * F.greatest(F.col(f"{k}_gap_") - 0.5, F.lit(0.0)) for k in sides), F.lit(0.0))
    hits = each.withColumn("votes", F.col("votes_") + F.coalesce(F.greatest(F.col("like") - gap, F.lit(0.0)), F.lit(0.0))).where(F.col("votes") >= ENOUGH)
    # a field goes to its best column, and a column to its best field among those it won
    hits = hits.groupBy("file_id", "idx").agg(F.min(F.struct((-F.col("votes")).alias("less"), "field", "code")).alias("h"))
    hits = hits.groupBy(F.col("file_id").alias("file_h")).agg(F.sort_array(F.collect_list(F.struct("h.code", "h.less", "idx"))).alias("all_"))
    first = F.filter("all_", lambda h, i: (i == 0) | (F.get(F.col("all_.code"), i - 1) != h["code"]))
    return hits.select("file_h", F.transform(first, lambda h: F.struct(h["code"].alias("code"), h["idx"].alias("idx"))).alias("hits_"))


def _pairs(layout: DataFrame) -> DataFrame:
    """(file_id, idx, code, field, votes_): each open column of a file beside each missing field, with the votes that need no values."""
    # outer, as the filter of empty arrays that Spark would infer is pushed to the header and computes all of the layout anew for each column
    out = layout.withColumn("missing_", F.filter("fields_", lambda f: f["idx"] == -1)).select("file_id", "heads_", "fields_", "missing_", F.posexplode_outer("slots_").alias("idx", "slot")).where("slot = -1")
    # the agreed fields on either side of the column, where the file keeps their order
    side = lambda keeps: F.transform(F.filter("fields_", lambda f: (f["idx"] >= 0) & keeps(f["idx"])), lambda f: f["pos"])
    lo = F.coalesce(F.array_max(side(lambda i: i < F.col("idx"))), F.lit(-1))
    hi = F.coalesce(F.array_min(side(lambda i: i > F.col("idx"))), F.lit(1 << 30))
    out = out.withColumns({"lo_": lo, "hi_": hi, "h": F.get("heads_", F.col("idx"))}).select("file_id", "idx", "h", "lo_", "hi_", F.explode_outer("missing_").alias("f"))
    out = out.select("file_id", "idx", "lo_", "hi_", F.col("h.plain").alias("plain"), F.col("f.field").alias("field"), F.col("f.pos").alias("pos"), F.col("f.code").alias("code"))
    known = [f"{a} {f}" for f, names in ALIASES.items() for a in names]
    alias = F.when(F.concat_ws(" ", "plain", "field").isin(known), ALIAS).otherwise(0.0) if known else F.lit(0.0)
    stem = lambda c: F.transform(F.split(c, "_"), lambda w: F.regexp_replace(w, "s$", ""))
    words = WORD * F.size(F.array_intersect(stem(F.col("plain")), stem(F.col("field")))) / F.size(stem(F.col("field")))
    place = F.when((F.col("lo_") < F.col("pos")) & (F.col("pos") < F.col("hi_")), PLACE).otherwise(0.0)
    return out.select("file_id", "idx", "code", "field", (alias + words + place).alias("votes_"))


def told(files: DataFrame, rows: DataFrame, std: DataFrame) -> DataFrame:
    """(file_id, kind, cols_, taken_): a row for each file; its columns, and the agreed fields of its kind with the column of each.

    cols_ (idx, header, name, field, filled, counts by tag): name is the header without blanks around it, or c0, c1, ... for
    blank headers counted from the left; field is the agreed field the column stands for or null; counts say how many of its
    values carry each tag. taken_ (field, types, idx): idx is -1 for a field without a column. A field is taken by
    the leftmost header of its own name; else by the column with the most votes, ENOUGH at least, if it is also
    the field with the most votes for this column. Columns with a blank header stand for nothing.
    """
    agreed = _fields(std)
    layout = _layout(files, agreed)
    marked = cut(marks(rows, layout))
    index = F.when(F.col("key_") < 0, -1 - F.col("key_")).otherwise(F.col("key_")).alias("idx")
    kinds = (*TYPES, "text")
    counts = [F.coalesce(F.sum(F.when(F.col("mark") == k + 1, F.col("n"))), F.lit(0)).alias(f"{t}_n") for k, t in enumerate(kinds)]
    seen = marked.where(F.col("file_").isNotNull() & (F.col("mark") <= len(kinds))).select(F.col("file_").alias("file_t"), index, "mark", "n").repartition("file_t")
    seen = seen.groupBy("file_t", "idx").agg(*counts).groupBy("file_t").agg(F.collect_list(F.struct("idx", *[f"{t}_n" for t in kinds])).alias("seen_"))
    out = layout.join(seen.hint("merge"), F.col("file_id") == F.col("file_t"), "left").join(_hits(layout, marked, agreed.count()).hint("merge"), F.col("file_id") == F.col("file_h"), "left")
    hit = lambda f: F.get(F.col("hits_.idx"), F.array_position(F.col("hits_.code"), f["code"]).cast("int") - 1)
    idx = lambda f: F.when(f["idx"] >= 0, f["idx"]).otherwise(F.coalesce(hit(f), F.lit(-1)))
    out = out.withColumn("taken_", F.transform("fields_", lambda f: F.struct(f["field"].alias("field"), f["types"].alias("types"), idx(f).alias("idx"))))
    blank = lambda i: F.size(F.filter(F.slice("heads_", 1, i + 1), lambda h: h["header"] == "")) - 1
    name = lambda h, i: F.when(h["header"] == "", F.concat(F.lit("c"), blank(i).cast("string"))).otherwise(h["header"])
    field = lambda i: F.get(F.col("taken_.field"), F.array_position(F.col("taken_.idx"), i).cast("int") - 1)
    place = lambda i: F.array_position(F.col("seen_.idx"), i).cast("int") - 1
    n = lambda t, i: F.coalesce(F.get(F.col(f"seen_.{t}_n"), place(i)), F.lit(0)).alias(f"{t}_n")
    cols = F.transform("heads_", lambda h, i: F.struct(i.alias("idx"), h["header"].alias("header"), name(h, i).alias("name"), field(i).alias("field"), *[n(t, i) for t in kinds]))
    return out.select("file_id", "kind", cols.alias("cols_"), "taken_")


def columns_of(files: DataFrame, rows: DataFrame, std: DataFrame) -> DataFrame:
    """(file_id, kind, idx, header, name, field, integer_n, date_n, time_n, text_n): each column of each file, as ``told`` has it."""
    return told(files, rows, std).select("file_id", "kind", F.inline_outer("cols_")).where("idx is not null")


def changes(files: DataFrame, rows: DataFrame, std: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name): each deviation of each file from the agreed fields of its kind, once.

    ``renamed``: a field stands under another name. ``removed``: it has no column. ``added``: a column with at least one
    value stands for no agreed field. ``retyped``: a value is not of the agreed type. Order, letter case, blanks
    around a header and columns without a value are no change; lines that come twice count once. A file of a kind that
    has no agreed fields has only added columns; a file with a null header has all its fields removed; a file without
    rows can have renamed and removed fields only.
    """
    change = lambda k, f: F.struct(F.lit(k).alias("change_kind"), f.alias("field_name"))
    filled = lambda c: sum((c[f"{t}_n"] for t in ("date", "time", "text")), c["integer_n"])
    col = lambda f: F.get("cols_", f["idx"])
    fits = lambda t, c: F.coalesce(*[F.when(t == k, c[f"{k}_n"]) for k in TYPES], filled(c))
    renamed = F.filter("taken_", lambda f: (f["idx"] >= 0) & (F.lower(col(f)["header"]) != f["field"]))
    removed = F.filter("taken_", lambda f: f["idx"] < 0)
    added = F.filter("cols_", lambda c: c["field"].isNull() & (filled(c) > 0))
    retyped = F.filter("taken_", lambda f: (f["idx"] >= 0) & F.exists(f["types"], lambda t: (t != "text") & (filled(col(f)) > fits(t, col(f)))))
    of = lambda k, c, by: F.transform(c, lambda x: change(k, x[by]))
    every = F.concat(of("renamed", renamed, "field"), of("removed", removed, "field"), of("added", added, "name"), of("retyped", retyped, "field"))
    return told(files, rows, std).select("file_id", F.inline_outer(every)).where("change_kind is not null").distinct()


def fused_schema(files: DataFrame, rows: DataFrame, std: DataFrame) -> DataFrame:
    """(kind, field_name, data_type, alternative, files, values, first_file): the tagged union of every agreed field."""
    full = columns_of(files, rows, std).where("field is not null")
    each = full.select("kind", "field", "file_id", F.explode(F.array(*[F.struct(F.lit(k).alias("alternative"), F.col(f"{k}_n").alias("n")) for k in (*TYPES, "text")])).alias("a")).where("a.n > 0")
    out = each.groupBy("kind", "field", "a.alternative").agg(F.count_distinct("file_id").alias("files"), F.sum("a.n").alias("values"), F.min("file_id").alias("first_file"))
    types = std.select(F.col("kind"), F.col("field_name"), "data_type").distinct()
    return out.withColumnRenamed("field", "field_name").join(types, ["kind", "field_name"]).select("kind", "field_name", "data_type", "alternative", "files", "values", "first_file")


def consistent(files: DataFrame, rows: DataFrame, std: DataFrame, kind: str) -> DataFrame:
    """One table of the kind: raw_id, file_id and the agreed fields in their order, each in its agreed type.

    A field of a type other than text is the canonical conversion (``45 min`` is 45, ``'13`` is 2013, ``9h30`` is 09:30);
    beside it ``<field>_text`` holds a value of another type as written, null where the value was of the agreed type.
    Fields that a file lacks, empty cells and values that can't be converted are null. Every record gives a row, lines
    that come twice included; values of added columns are kept in ``extra`` (map by name, a repeated name with its number).
    """
    fields = [(r["field_name"], r["data_type"]) for r in std.where(F.col("kind") == kind).orderBy("pos").select("field_name", "data_type").distinct().toLocalIterator()]
    order = {r["field_name"]: r["pos"] for r in std.where(F.col("kind") == kind).select("field_name", "pos").toLocalIterator()}
    fields.sort(key=lambda x: order[x[0]])
    of_kind = files.where(F.col("kind") == kind)
    own = columns_of(of_kind, rows, std)
    # an added header that a file repeats counts on from its second column: room, room#2
    again = F.row_number().over(Window.partitionBy("file_id", "name").orderBy("idx"))
    own = own.withColumn("again", again).withColumn("f", F.coalesce("field", F.concat(F.lit("+"), F.col("name"), F.when(F.col("again") > 1, F.concat(F.lit("#"), F.col("again").cast("string"))).otherwise(""))))
    names = own.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("idx", "f"))).alias("m_"))
    parsed = rows.select("raw_id", "file_id", F.transform(csv_fields(F.col("record_line")), strip).alias("v_"))
    # the mapping of a file goes to its rows; AQE splits the partition of a file that holds most of them
    wide = parsed.join(names.hint("merge"), "file_id").withColumn("kv_", F.map_from_entries(F.transform("m_", lambda s: F.struct(s["f"], F.nullif(F.get("v_", s["idx"]), F.lit(""))))))
    out = wide.select("raw_id", "file_id", *[F.try_element_at("kv_", F.lit(f)).alias(f) for f, _ in fields], F.map_filter("kv_", lambda k, v: k.startswith("+") & v.isNotNull()).alias("extra"))
    out = out.withColumn("extra", F.transform_keys("extra", lambda k, _: F.substring(k, 2, 1000)))
    for f, t in fields:
        if t != "text":
            out = out.withColumn(f"{f}_text", F.when(tag(F.col(f)) != t, F.col(f)))
    for f, t in fields:
        out = _convert(out, f, t)
    return out.select("raw_id", "file_id", *[c for f, t in fields for c in ([f] if t == "text" else [f, f"{f}_text"])], "extra")


def _convert(df: DataFrame, f: str, t: str) -> DataFrame:
    c = F.col(f)
    if t == "integer":
        number = F.regexp_extract(c, "(\\d+)", 1).try_cast("int")
        short = F.when(number < 70, number + 2000).when(number < 100, number + 1900).otherwise(number)
        clock = F.regexp_extract(c, "^(\\d{1,2}):\\d\\d$", 1).try_cast("int") * 60 + F.regexp_extract(c, ":(\\d\\d)$", 1).try_cast("int")
        return df.withColumn(f, F.when(c.rlike("^\\d{1,2}:\\d\\d$"), clock).when(c.rlike("^['’]\\d\\d$"), short).otherwise(number))
    if t == "date":
        kept = df.columns
        year = "year" if "year" in kept else None
        near = F.regexp_extract(F.col(year).cast("string"), "(\\d{4})", 1).try_cast("int") if year else F.lit(None).cast("int")
        df = with_days(df.withColumns({"d_": tidy(c), "y_": near}), "d_", "y_", "days_")
        return df.withColumn(f, F.get("days_", F.lit(0))).select(*kept)
    if t == "time":
        kept = df.columns
        df = with_clock(df.withColumn("t_", tidy(c)), "t_", "c_")
        part = F.when(c.rlike("^0\\.\\d+$"), F.round(c.try_cast("double") * 1440).cast("int") * 60)
        secs = F.coalesce(F.when(F.col("c_.ok") & ~c.rlike("^0\\.\\d{3,}$"), F.col("c_.seconds")), part)
        text = F.concat_ws(":", F.lpad(F.floor(secs / 3600).cast("string"), 2, "0"), F.lpad((F.floor(secs / 60) % 60).cast("string"), 2, "0"), F.lpad((secs % 60).cast("string"), 2, "0"))
        return df.withColumn(f, F.when(secs.isNotNull(), text)).select(*kept)
    return df
