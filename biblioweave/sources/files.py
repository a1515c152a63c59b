"""Delivered files: CSV of drifting headers, JSON papers, BibTeX, iCalendar and saved web pages."""

from __future__ import annotations


import html.parser
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Columns of the files that are written, in their order (fixed values).
TALKS = ("venue", "year", "paper_type", "title", "speakers", "authors", "affiliations", "abstract", "arxiv_ids", "presentation_url", "video_url", "youtube_id", "session_name", "award", "notes", "scheduled_date", "scheduled_time", "duration_minutes")
MEMBERS = ("venue", "year", "committee_type", "position", "full_name", "affiliation", "role_title")


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of CSV files, all strings, with file name and line order; quoted line breaks and doubled quotes are undone.

    Files may have different headers: each header is read for itself and columns that a file lacks are null.
    """
    parts = []
    for p in paths:
        df = spark.read.csv(p, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False)
        parts.append(df.withColumn("file_name", F.col("_metadata.file_name")).withColumn("line_order", F.monotonically_increasing_id()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_row_conference(df: DataFrame) -> DataFrame:
    """``df`` with venue and year of each file's first row on all its rows, as the importer takes them."""
    head = df.groupBy("file_name").agg(F.min_by(F.struct("venue", "year"), "line_order").alias("h"))
    return df.drop("venue", "year").join(head, "file_name").withColumns({"venue": F.upper("h.venue"), "year": F.col("h.year").try_cast("int")}).drop("h")


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = TALKS, overwrite: bool = False) -> None:
    """Write the columns in their order, lists joined by semicolons without empty items; an existing path is kept unless told otherwise."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.lit(None).cast("string").alias(c) if c not in kinds else (F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), ";") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c)
    df.select(*map(cell, columns)).write.mode("overwrite" if overwrite else "error").option("escape", '"').csv(path, header=True)


def papers_of_json(spark: SparkSession, path: str) -> DataFrame:
    """Accepted papers of a JSON file with nested authors, tags and topics; lists become cells with semicolons."""
    schema = "title string, abstract string, decision string, arxiv_number_url string, authors array<struct<first:string,last:string,affiliation:string>>, tags array<struct<tag:string>>, topics array<string>"
    raw = spark.read.schema(schema).json(path, multiLine=True).where(F.col("decision").contains("Accepted"))
    name = lambda a: F.trim(F.concat_ws(" ", a["first"], a["last"]))
    return raw.select("title", "abstract", "decision", "arxiv_number_url", F.array_join(F.transform("authors", name), ";").alias("authors"), F.array_join(F.transform("authors", lambda a: F.coalesce(a["affiliation"], F.lit(""))), ";").alias("affiliations"), F.array_join(F.transform("tags", lambda t: t["tag"]), ";").alias("tags"), F.array_join("topics", ";").alias("topics"))


def local_path(url: Column, base: str) -> Column:
    """Where the mirror of a page lies under ``base``: pages without a file ending are ``index.html`` of their folder."""
    bare = F.regexp_replace(F.url_decode(url), "^https?://", "")
    full = F.concat(F.lit(base.rstrip("/") + "/"), bare)
    return F.when(bare.rlike("^[^/]+/(?:.*/)?[^/]*\\.[^/]*$"), full).otherwise(F.concat(F.regexp_replace(full, "/+$", ""), F.lit("/index.html")))


def first_url(*columns: str) -> Column:
    """The first link of an order of preference that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value"))


def _entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, id, fields) of BibTeX entries; braces nest, values may be in braces or quotes."""
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        depth, k = 1, m.end()
        while k < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[k], 0)
            k += 1
        body, fields, at = text[m.end() : k - 1], {}, 0
        while f := re.compile(r"(\w+)\s*=\s*").search(body, at):
            j = f.end()
            if j < len(body) and body[j] == "{":
                level, e = 1, j + 1
                while e < len(body) and level:
                    level += {"{": 1, "}": -1}.get(body[e], 0)
                    e += 1
                value, at = body[j + 1 : e - 1], e
            elif j < len(body) and body[j] == '"':
                e = body.find('"', j + 1)
                e = len(body) if e < 0 else e
                value, at = body[j + 1 : e], e + 1
            else:
                e = body.find(",", j)
                e = len(body) if e < 0 else e
                value, at = body[j:e], e
            fields.setdefault(f[1].lower(), " ".join(value.split()))
        yield m[1], m[2], fields


def read_bibtex(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("Talk", "Conference", "Workshop")) -> DataFrame:
    """One row an entry of the wanted types: entry_id, entry_type and the usual fields; null for fields it lacks."""
    names = ("title", "author", "year", "url", "abstract", "keywords", "howpublished")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i, t, *(f.get(x) for x in names)) for n, text in zip(b["file_name"], b["value"], strict=True) for t, i, f in _entries(text) if t in kinds]
            yield pd.DataFrame(rows, columns=["file_name", "entry_id", "entry_type", *names])

    return _whole(spark, path).mapInPandas(run, "file_name string, entry_id string, entry_type string, " + ", ".join(f"{n} string" for n in names))


def _events(text: str) -> Iterator[dict[str, str]]:
    """Properties of the events of a calendar; folded lines joined, escapes undone."""
    lines = re.sub(r"\r?\n[ \t]", "", text).splitlines()
    event: dict[str, str] | None = None
    for line in lines:
        if line == "BEGIN:VEVENT":
            event = {}
        elif line == "END:VEVENT" and event is not None:
            yield event
            event = None
        elif event is not None and ":" in line:
            name, value = line.split(":", 1)
            event.setdefault(name.split(";")[0].lower(), re.sub(r"\\([,;\\])", r"\1", value.replace("\\n", "\n").replace("\\N", "\n")))


def read_calendar(spark: SparkSession, path: str, year: int, utc_offset_hours: int = 0) -> DataFrame:
    """(file_name, date, time, duration_minutes, summary, description) of the events of a year; times in UTC are moved by the offset."""

    def local(v: str | None) -> pd.Timestamp | None:
        if not v or not re.fullmatch(r"\d{8}(?:T\d{6}Z?)?", v):
            return None
        t = pd.Timestamp(v.rstrip("Z"))
        return t + pd.Timedelta(hours=utc_offset_hours) if v.endswith("Z") else t

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, text in zip(b["file_name"], b["value"], strict=True):
                for e in _events(text):
                    start, end = local(e.get("dtstart")), local(e.get("dtend"))
                    if start is None or start.year != year:
                        continue
                    timed = "T" in e["dtstart"]
                    minutes = int((end - start).total_seconds() // 60) if timed and end is not None and end > start else None
                    rows.append((n, f"{start:%Y-%m-%d}", f"{start:%H:%M:%S}" if timed else "", minutes, e.get("summary"), e.get("description")))
            out = pd.DataFrame(rows, columns=["file_name", "date", "time", "duration_minutes", "summary", "description"])
            yield out.astype({"duration_minutes": "Int64"})

    return _whole(spark, path).mapInPandas(run, "file_name string, date string, time string, duration_minutes long, summary string, description string")


class _Blocks(html.parser.HTMLParser):
    """Blocks of a page in order: (kind, level, text, links), with headings, list items, table cells, paragraphs and marks of emphasis."""

    BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "p", "dt", "dd", "title")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str, str]] = []
        self.kind, self.text, self.links, self.bold, self.in_bold = "", [], [], [], 0
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.kind:
            self.rows.append((self.kind, text, " ".join(self.links), " ".join("".join(self.bold).split())))
        self.text, self.links, self.bold = [], [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS:
            self.flush()
            self.kind = tag
        elif tag == "br":
            self.flush()
        elif tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.links.append(href)
        elif tag in ("b", "strong", "em", "i", "u"):
            self.in_bold += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self.flush()
            self.kind = ""
        elif tag in ("b", "strong", "em", "i", "u"):
            self.in_bold = max(0, self.in_bold - 1)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)
            if self.in_bold:
                self.bold.append(data + " ")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, pos, kind, text, links, emphasis) of saved pages: their blocks in order, with the links in each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, text in zip(b["file_name"], b["value"], strict=True):
                parser = _Blocks()
                parser.feed(text)
                parser.flush()
                rows += [(n, k, *r) for k, r in enumerate(parser.rows)]
            yield pd.DataFrame(rows, columns=["file_name", "pos", "kind", "text", "links", "emphasis"])

    return _whole(spark, path).mapInPandas(run, "file_name string, pos int, kind string, text string, links string, emphasis string")


def members_under_headings(blocks: DataFrame, committee: Column) -> DataFrame:
    """(file_name, pos, committee_type, text): items of lists and paragraphs under the heading that names their committee."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("kind").rlike("^h[1-6]$")
    # any heading ends a section; one that names no committee begins none
    marked = blocks.withColumn("c_", F.last(F.when(head, F.coalesce(committee, F.lit(""))), ignorenulls=True).over(w))
    return marked.where(~head & F.col("kind").isin("li", "p", "td") & (F.col("c_") != "")).select("file_name", "pos", F.col("c_").alias("committee_type"), "text")


class _Cards(html.parser.HTMLParser):
    """Cards of a proceedings volume: one dict a paper, front matter and the volume itself left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict[str, object]] = []
        self.card: dict[str, object] | None = None
        self.depth, self.field = 0, ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if self.card is None:
            paper = re.search(r"\.(\d+)$", a.get("data-permanent-id", ""))
            if tag == "div" and "card" in classes and paper and int(paper[1]):
                self.card, self.depth = {"id": a["data-permanent-id"], "title": "", "doi": "", "category": "", "authors": [], "pdf": ""}, 1
            return
        self.depth += tag == "div"
        if a.get("data-key", "").endswith("contributor.author") and a.get("data-value", "").strip():
            self.card["authors"].append(a["data-value"].strip())
        if tag == "a" and a.get("href", "").endswith(".pdf") and not self.card["pdf"]:
            self.card["pdf"] = a["href"]
        self.field = "title" if tag == "h5" else next((c for c in classes if c in ("doi", "category")), self.field)

    def handle_endtag(self, tag: str) -> None:
        if self.card is None:
            return
        if tag in ("h5", "div"):
            self.field = ""
        self.depth -= tag == "div"
        if not self.depth:
            if self.card["title"] and self.card["authors"] and "front matter" not in str(self.card["category"]).lower():
                self.cards.append(self.card)
            self.card = None

    def handle_data(self, data: str) -> None:
        if self.card is not None and self.field:
            self.card[self.field] = " ".join(f"{self.card[self.field]} {data}".split())


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, pos, title, authors, doi, presentation_url, notes) of the papers of saved proceedings volumes; names given first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, text in zip(b["file_name"], b["value"], strict=True):
                parser = _Cards()
                parser.feed(text)
                for k, c in enumerate(parser.cards):
                    names = [" ".join(reversed([x.strip() for x in a.split(",", 1)])) for a in c["authors"]]
                    doi = str(c["doi"]).replace("DOI:", "").strip()
                    rows.append((n, k, c["title"], ";".join(names), doi, c["pdf"], f"DOI: {doi}" if doi else ""))
            yield pd.DataFrame(rows, columns=["file_name", "pos", "title", "authors", "doi", "presentation_url", "notes"])

    return _whole(spark, path).mapInPandas(run, "file_name string, pos int, title string, authors string, doi string, presentation_url string, notes string")


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Saved metadata of videos, a JSON object a file; what is missing is empty, files that are no JSON or have no id give no row."""
    names = ("id", "title", "description", "channel_id", "channel_url", "upload_date", "playlist_id")
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("mode", "PERMISSIVE").json(path, multiLine=True)
    return raw.where("id is not null").select("id", *[F.coalesce(n, F.lit("")).alias(n) for n in names[1:]])


def video_source(videos: DataFrame) -> DataFrame:
    """(source): the playlist that most videos are in, else the uploads of their most frequent channel; no row without either. Ties go by name."""
    top = lambda c, link, rank: videos.where(F.col(c) != "").groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).select(F.struct(F.lit(rank).alias("rank"), (-F.col("n")).alias("n"), "k").alias("o"), link.alias("source"))
    lists = top("playlist_id", F.concat(F.lit("https://www.youtube.com/playlist?list="), F.col("k")), 0)
    channels = top("channel_url", F.concat(F.regexp_replace("k", "/+$", ""), F.lit("/videos")), 1)
    return lists.union(channels).agg(F.min_by("source", "o").alias("source")).where("source is not null")


_LITERAL = re.compile(r"\s*(?:'((?:[^']|'')*)'|(\w[\w.+-]*|-?\d[\d.]*)|([(),;]))|--[^\n]*|\s+")


def _seed_rows(text: str) -> Iterator[dict[str, str | None]]:
    """Rows of the INSERT statements of an SQL text as dicts of texts; NULL is None, comments are passed over."""
    for m in re.finditer(r"INSERT\s+INTO\s+\w+\s*\(([^)]*)\)\s*VALUES", text, re.I):
        names, at, row = [c.strip() for c in m[1].split(",")], m.end(), None
        while t := _LITERAL.match(text, at):
            at = t.end()
            if t[3] == "(":
                row = []
            elif t[3] == ")" and row is not None:
                yield dict(zip(names, row, strict=False))
                row = None
            elif row is None and (t[2] or t[3] == ";"):
                break
            elif row is not None and (t[1] is not None or t[2]):
                row.append(t[1].replace("''", "'") if t[1] is not None else None if t[2].upper() == "NULL" else t[2])


def read_seeds(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns, as texts, of the rows that SQL seed files insert; null for columns that a statement doesn't give."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([[r.get(c) for c in columns] for text in b["value"] for r in _seed_rows(text)], columns=list(columns))

    return _whole(spark, path).mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def importer_columns(df: DataFrame, fix_names: bool = False) -> DataFrame:
    """Delivered rows as the importer reads them: only speakers and affiliation count, lists part at semicolons, no row is of the proceedings track.

    ``fix_names`` takes ``speaker`` for speakers and ``affiliations`` for a missing affiliation, parts arXiv lists at commas too, and reads the track.
    """
    has = lambda c: F.nullif(F.trim(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    speakers, affiliation, ids = has("speakers"), has("affiliation"), has("arxiv_ids")
    track = F.lit(False)
    if fix_names:
        speakers, affiliation = F.coalesce(speakers, has("speaker")), F.coalesce(affiliation, has("affiliations"))
        ids, track = F.replace(ids, F.lit(","), F.lit(";")), F.coalesce(F.upper(has("is_proceedings_track")) == "TRUE", F.lit(False))
    parts = F.filter(F.transform(F.split(ids, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({"speakers": speakers, "affiliation": affiliation, "arxiv_ids": F.coalesce(parts, F.array().cast("array<string>")), "is_proceedings_track": track})


def section(blocks: DataFrame, pattern: str) -> DataFrame:
    """(file_name, pos, kind, text): of each page the blocks of the first section, not empty, whose heading matches ``pattern``.

    A section ends at the next heading of its level or a higher one. The blocks of a page are few; pages don't meet.
    """
    level = F.regexp_extract("kind", "^h([1-6])$", 1).try_cast("int")
    heads = blocks.withColumn("level", level).where("level is not null").select("file_name", F.col("pos").alias("at"), "level", F.col("text").alias("head"))
    mine = heads.where(F.col("head").rlike(pattern))
    later = heads.select("file_name", F.col("at").alias("next"), F.col("level").alias("next_level"))
    ends = mine.join(later, "file_name").where((F.col("next") > F.col("at")) & (F.col("next_level") <= F.col("level"))).groupBy("file_name", "at").agg(F.min("next").alias("end"))
    spans = mine.join(ends, ["file_name", "at"], "left").select("file_name", "at", F.coalesce("end", F.lit((1 << 31) - 1)).alias("end"))
    inside = blocks.withColumn("level", level).where("level is null").join(spans, "file_name").where((F.col("pos") > F.col("at")) & (F.col("pos") < F.col("end")))
    first = inside.groupBy("file_name").agg(F.min("at").alias("first_"))
    return inside.join(first, "file_name").where("at = first_").select("file_name", "pos", "kind", "text")


def rewrite_csv(df: DataFrame, path: str, columns: tuple[str, ...] = TALKS, commit: bool = False) -> bool:
    """Replace the CSV files at ``path`` by ``df``; without ``commit`` nothing is written. The new files are whole before the old ones go."""
    if commit:
        write_csv(df, f"{path}.new", columns, overwrite=True)
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        fs = old.getFileSystem(conf)
        fs.delete(old, True)
        fs.rename(new, old)
    return commit
