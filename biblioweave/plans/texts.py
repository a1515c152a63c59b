"""What the column functions make of the texts of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.functions import validate as V
from biblioweave.plans.reference import _importer
from biblioweave.plans.registry import query
from biblioweave.plans.silver import sql_collapse, sql_fold, sql_items
from biblioweave.sources.tables import table

# names and titles


@query(f"WITH n AS (SELECT author_id, {_importer(sql_fold('full_name'))} n FROM authors) SELECT author_id, string_split(n, ' ')[-1] family, array_to_string(string_split(n, ' ')[:-2], ' ') given FROM n")
def importer_name_parts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "authors", "author_id", "full_name").select("author_id", N.importer_split(F.col("full_name")).alias("s")).select("author_id", "s.family", "s.given")


# accents are folded before titles are cut out, as word ends of this engine's patterns know ASCII only
_BARE = f"regexp_replace({sql_fold('coalesce(full_name, chr(0))')}, '(?i)\\b(Dr|Prof|Jr|Sr|Ph\\.?D|M\\.?D)\\b\\.?\\s*', ' ', 'g')".replace("chr(0)", "''")
_FIXED = f"array_to_string(list_filter(string_split({sql_collapse(f'lower({sql_fold(_BARE)})')}, ' '), lambda t: NOT regexp_full_match(t, '[a-z]\\.?')), ' ')"


@query(f"""SELECT member_id, {_FIXED} mended, {_importer(sql_fold("coalesce(full_name, '')"))} imported FROM committees""")
def importer_names_mended(spark: SparkSession, base: str) -> DataFrame:
    """The importer's form of names, and the same with titles cut out only where a word ends."""
    n = F.col("full_name")
    return table(spark, base, "committees", "member_id", "full_name").select("member_id", N.importer_name(n, True).alias("mended"), N.importer_name(n).alias("imported"))


@query(f"""SELECT record_id, trim(regexp_replace('QIP2023 | Day 3: ' || title, '(?i)^(?:\\s*(?:(?:QCRYPT|QIP|TQC)(?:\\s*\\d{{1,4}})?|\\[?\\d{{4}}\\]?|day\\s*\\d+)\\s*[:|–—-])+\\s*', '')) bare,
{sql_collapse(f"regexp_replace(lower({sql_fold('''regexp_replace('TUTORIAL: ' || title, '(?i)^(?:TUTORIAL|PLENARY|SHORT PLENARY [0-9]+|INVITED PLENARY [0-9]*):?[[:space:]]*', '')''')}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")} unprefixed FROM workshop WHERE title IS NOT NULL""")
def video_titles(spark: SparkSession, base: str) -> DataFrame:
    """Titles as a recording bears them, without the labels before them."""
    w = table(spark, base, "workshop", "record_id", "title").where("title is not null")
    return w.select("record_id", N.strip_tags(F.concat(F.lit("QIP2023 | Day 3: "), F.col("title"))).alias("bare"), N.title_unprefixed(F.concat(F.lit("TUTORIAL: "), F.col("title"))).alias("unprefixed"))


@query(f"SELECT member_id, nullif({sql_collapse('affiliation')}, '') affiliation FROM committees")
def tidy_affiliations(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "committees", "member_id", "affiliation").select("member_id", N.affiliation(F.col("affiliation")).alias("affiliation"))


_LATEX = "regexp_replace(regexp_replace('$x$ \\emph{' || title || '} \\leq 3\\%', '\\$([^$]+)\\$', '\\1', 'g'), '\\\\(?:emph|textbf|textit)\\{([^}]+)\\}', '\\1', 'g')"


@query(f"""SELECT paper_id, regexp_replace(replace(replace(replace(replace(replace({_LATEX}, '\\leq', '≤'), '\\geq', '≥'), '\\cdot', '·'), '\\circ', '∘'), '\\times', '×'), '\\\\([^A-Za-z])', '\\1', 'g') AS plain FROM papers_compact WHERE title IS NOT NULL""")
def plain_latex(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "papers_compact", "paper_id", "title").where("title is not null")
    return p.select("paper_id", N.clean_latex(F.concat(F.lit("$x$ \\emph{"), F.col("title"), F.lit("} \\leq 3\\%"))).alias("plain"))


# identifiers and kinds


@query("""WITH t AS (SELECT record_id, list_filter(list_transform(list_filter(list_transform(string_split(replace(arxiv_ids, ';', ','), ','), lambda x: trim(x)), lambda x: NOT contains(lower(x), 'doi.org') AND NOT (starts_with(x, 'http') AND NOT contains(lower(x), 'arxiv'))), lambda x: regexp_extract(x, '(\\d{4}\\.\\d{4,5})', 1)), lambda x: x <> '') l FROM workshop)
SELECT record_id, nullif(array_to_string(list_sort(list_distinct(l)), ';'), '') ids FROM t""")
def arxiv_lists(spark: SparkSession, base: str) -> DataFrame:
    """Ids of lists written with commas."""
    ids = X.arxiv_from_list(F.replace(F.col("arxiv_ids"), F.lit(";"), F.lit(",")))
    return table(spark, base, "workshop", "record_id", "arxiv_ids").select("record_id", F.array_join(F.array_sort(F.split(ids, ";")), ";").alias("ids"))


@query("""WITH t AS (SELECT record_id, list_distinct(list_concat(regexp_extract_all(concat_ws(' ', arxiv_ids, abstract), '(?:^|[^\\d.])(\\d{4}\\.\\d{4,5})', 1), regexp_extract_all(concat_ws(' ', arxiv_ids, abstract), '([a-z]+(?:-[a-z]+)?(?:\\.[A-Z]{2})?/\\d{7})', 1))) l FROM workshop) SELECT record_id, array_to_string(list_sort(l), ';') ids FROM t WHERE len(l) > 0""")
def arxiv_both_styles(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "arxiv_ids", "abstract")
    return w.select("record_id", F.array_join(F.array_sort(X.arxiv_ids_any(F.concat_ws(" ", "arxiv_ids", "abstract"))), ";").alias("ids")).where("ids <> ''")


@query("SELECT record_id, nullif(regexp_extract('https://youtu.be/' || youtube_id, '(?:youtube\\.com/(?:watch\\?v=|embed/)|youtu\\.be/)([A-Za-z0-9_-]{11})', 1), '') AS video FROM workshop")
def youtube_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "workshop", "record_id", "youtube_id").select("record_id", X.youtube_id(F.concat(F.lit("https://youtu.be/"), F.col("youtube_id"))).alias("video"))


@query("""WITH t AS (SELECT record_id, lower(concat_ws(' ', session_name, title)) x, CASE WHEN regexp_full_match(trim(duration_minutes), '\\d+') THEN trim(duration_minutes)::BIGINT END m FROM workshop)
SELECT record_id, CASE WHEN contains(x, 'tutorial') THEN 'tutorial' WHEN contains(x, 'public lecture') OR contains(x, 'public talk') THEN 'public_lecture' WHEN contains(x, 'plenary') THEN 'plenary' WHEN contains(x, 'invited') OR contains(x, 'featured') THEN 'invited' WHEN contains(x, 'poster') THEN 'poster' WHEN m >= 45 THEN 'invited' ELSE 'regular' END timed,
CASE WHEN contains(x, 'plenary') THEN CASE WHEN m >= 60 THEN 'plenary_long' ELSE 'plenary_short' END ELSE 'regular' END decided FROM t""")
def timed_talk_types(spark: SparkSession, base: str) -> DataFrame:
    """Kinds of talks by the rules of timetables and of decisions."""
    w = table(spark, base, "workshop", "record_id", "session_name", "title", "duration_minutes")
    text, minutes = F.concat_ws(" ", "session_name", "title"), X.duration(F.col("duration_minutes"))
    return w.select("record_id", X.paper_type_timed(text, minutes).alias("timed"), X.paper_type_decided(text, minutes).alias("decided"))


def _held(x: str, words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)


@query(f"""WITH t AS (SELECT record_id, lower(trim(concat_ws(' ', session_name, title))) x FROM workshop) SELECT record_id, len(x) >= 1 AND NOT ({_held('x', X.NO_TALK_CALENDAR)}) in_calendar, NOT regexp_matches(x, '{X.NO_TALK_VIDEO}') in_videos FROM t""")
def talk_items_elsewhere(spark: SparkSession, base: str) -> DataFrame:
    """Which items count as talks by the word lists of calendars and of video titles."""
    text = F.lower(F.trim(F.concat_ws(" ", "session_name", "title")))
    return table(spark, base, "workshop", "record_id", "session_name", "title").select("record_id", X.is_talk(text, X.NO_TALK_CALENDAR).alias("in_calendar"), (~text.rlike(X.NO_TALK_VIDEO)).alias("in_videos"))


# committees

_HEAD = "replace(committee_type, '_', ' ') || ' committee'"


@query("SELECT member_id, CASE " + " ".join(f"WHEN regexp_matches({_HEAD}, '(?i)\\b{p}\\b') THEN '{v}'" for p, v in X.HEADINGS) + " END kind FROM committees")
def committee_headings(spark: SparkSession, base: str) -> DataFrame:
    head = F.concat(F.translate("committee_type", "_", " "), F.lit(" committee"))
    return table(spark, base, "committees", "member_id", "committee_type").select("member_id", X.committee_of_heading(head).alias("kind"))


@query("""WITH t AS (SELECT member_id, trim(full_name) x FROM committees WHERE full_name IS NOT NULL) SELECT member_id, NOT regexp_matches(x, '(?i)https?://|www\\.') AND len(regexp_replace(x, '[^\\p{L}]', '', 'g')) >= 3 AND len(x) BETWEEN 3 AND 100 AND regexp_matches(x, '\\S\\s+\\S|\\(') AND upper(x) <> x AND lower(x) <> x plausible FROM t""")
def plausible_members(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "committees", "member_id", "full_name").where("full_name is not null").select("member_id", X.plausible_member(F.col("full_name")).alias("plausible"))


@query("""WITH t AS (SELECT member_id, trim(full_name) n, trim(affiliation) a FROM committees WHERE trim(full_name) <> '' AND trim(affiliation) <> '' AND NOT regexp_matches(full_name || affiliation, '[,;()\\[\\]:–—]|(?i)chair|\\s-') AND NOT regexp_matches(full_name || affiliation, '[^\\x21-\\x7e\\x{00c0}-\\x{024f} ]') AND NOT regexp_matches(full_name || affiliation, '  ')) SELECT member_id, n || ', ' || a bare, n AS name, a affiliation, 'co_chair' AS position, 'Co-Chair' role FROM t""")
def member_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines of a committee page (name, affiliation, role) taken apart again; names and affiliations with marks of their own aside."""
    c = table(spark, base, "committees", "member_id", "full_name", "affiliation").select("member_id", F.trim("full_name").alias("n"), F.trim("affiliation").alias("a")).where("n <> '' and a <> ''")
    both = F.concat("n", "a")
    c = c.where(~both.rlike("[,;()\\[\\]:–—]|(?i)chair|\\s-") & ~both.rlike("[^\\x21-\\x7e\\u00c0-\\u024f ]") & ~both.rlike("  "))
    line = F.concat(F.col("n"), F.lit(", "), F.col("a"), F.lit(" - co-chair"))
    bare = X.without_role(line)
    parts, role = X.name_and_affiliation(bare), X.position_and_role(line)
    return c.select("member_id", bare.alias("bare"), parts["name"].alias("name"), parts["affiliation"].alias("affiliation"), role["position"].alias("position"), role["role_title"].alias("role"))


# people in texts


@query("""WITH t AS (SELECT talk_id, trim(speaker) s, title FROM talks WHERE regexp_full_match(trim(speaker), '[A-Za-z]+( [A-Za-z]+){1,3}') AND title IS NOT NULL)
SELECT talk_id, s lettered, s plain, trim(title) title FROM t""")
def calendar_summaries(spark: SparkSession, base: str) -> DataFrame:
    """Speakers and titles read from summaries as a calendar writes them."""
    t = table(spark, base, "talks", "talk_id", "speaker", "title").select("talk_id", F.trim("speaker").alias("s"), "title").where(F.col("s").rlike("^[A-Za-z]+( [A-Za-z]+){1,3}$") & F.col("title").isNotNull())
    plain = F.concat(F.col("s"), F.lit(" - "), F.col("title"))
    return t.select("talk_id", X.speaker_of_summary(F.concat(F.lit("A) "), plain)).alias("lettered"), X.speaker_of_summary(plain).alias("plain"), X.title_of_summary(F.concat(F.lit("B: "), F.translate("title", ":|", "  "), F.lit(" | "), F.col("s"))).alias("title_shown"), "title").select("talk_id", "lettered", "plain", F.when(F.col("title").rlike("[:|]"), F.trim("title")).otherwise(F.col("title_shown")).alias("title"))


@query("""WITH t AS (SELECT talk_id, trim(speaker) s FROM talks WHERE regexp_full_match(trim(speaker), '[A-Z][a-z]+ [A-Z][a-z]+')) SELECT talk_id, s AS name, 'video_desc' AS source FROM t""")
def video_speakers(spark: SparkSession, base: str) -> DataFrame:
    """The likeliest speaker by a video's description and title."""
    t = table(spark, base, "talks", "talk_id", "speaker").select("talk_id", F.trim("speaker").alias("s")).where(F.col("s").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"))
    found = X.speaker_candidates(F.concat(F.lit("A talk - "), F.col("s")), F.concat(F.lit("Speaker: "), F.col("s"), F.lit("\nmore")))
    return t.select("talk_id", F.get(found, F.lit(0)).alias("f")).select("talk_id", "f.name", "f.source")


@query("""WITH t AS (SELECT record_id, regexp_replace(trim(regexp_replace(authors, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g')), '[.,]+$', ',') x FROM workshop WHERE authors IS NOT NULL AND NOT regexp_matches(authors, ' and |[;"]|[^\\x20-\\x7e]')),
p AS (SELECT record_id, list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y: len(y) >= 2) l FROM t) SELECT record_id, len(list_distinct(list_transform(l, lambda y: lower(y)))) n, l[1] first_name FROM p""")
def listed_authors(spark: SparkSession, base: str) -> DataFrame:
    """How many names a cell with commas lists, and the first."""
    w = table(spark, base, "workshop", "record_id", "authors").where("authors is not null").where(~F.col("authors").rlike(' and |[;"]|[^\\x20-\\x7e]'))
    names = X.authors_of_text(F.col("authors"))
    return w.select("record_id", F.size(names).alias("n"), F.get(names, F.lit(0)).alias("first_name"))


@query("SELECT author_id, trim(given_name) || ' ' || trim(family_name) flipped FROM authors WHERE trim(given_name) <> '' AND trim(family_name) <> '' AND NOT contains(family_name, ',')")
def flipped_names(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "given_name", "family_name").where("trim(given_name) <> '' and trim(family_name) <> '' and not contains(family_name, ',')")
    return a.select("author_id", X.flip_family_first(F.concat_ws(", ", "family_name", "given_name")).alias("flipped"))


# dates, times, lists, checks


@query("""SELECT record_id, try_strptime(regexp_extract(scheduled_date, '^(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d')::DATE AS day FROM workshop WHERE regexp_matches(scheduled_date, '^\\d{4}-\\d{2}-\\d{2}')""")
def imported_days(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "year", "scheduled_date").where(F.col("scheduled_date").rlike("^\\d{4}-\\d{2}-\\d{2}"))
    return w.select("record_id", X.importer_date(F.col("scheduled_date"), F.col("year")).alias("day"))


@query("""WITH t AS (SELECT record_id, regexp_extract(scheduled_time, '(\\d{1,2})[:.](\\d{2})(?:\\s*[-–]\\s*(\\d{1,2})[:.](\\d{2}))?', ['a', 'b', 'c', 'd']) x FROM workshop)
SELECT record_id, CASE WHEN x.a <> '' THEN printf('%02d:%02d', try_cast(x.a AS INT), try_cast(x.b AS INT)) END AS start, coalesce(try_cast(x.c AS BIGINT) * 60 + try_cast(x.d AS BIGINT) - try_cast(x.a AS BIGINT) * 60 - try_cast(x.b AS BIGINT), 0) AS minutes FROM t""")
def time_ranges(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "workshop", "record_id", "scheduled_time").select("record_id", X.time_range(F.col("scheduled_time")).alias("r")).select("record_id", "r.start", "r.minutes")


@query("SELECT venue, year::BIGINT AS year, start_date + ((2 - (isodow(start_date) - 1) + 7) % 7)::INT AS wednesday FROM conferences WHERE start_date IS NOT NULL")
def first_wednesdays(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "conferences", "venue", "year", "start_date").where("start_date is not null")
    return c.select("venue", "year", X.day_of_conference(F.lit("Wednesday morning"), F.col("start_date")).alias("wednesday"))


@query(f"""WITH t AS (SELECT record_id, list_transform(string_split(affiliations, ';'), lambda x: trim(x)) k, {sql_items('affiliations')} d FROM workshop WHERE trim(affiliations) <> '') SELECT record_id, len(k) places, len(d) filled, coalesce(k[2], '') second_kept FROM t""")
def aligned_affiliations(spark: SparkSession, base: str) -> DataFrame:
    """Empty places of a list kept or dropped: as imported, dropped ones shift those that follow."""
    w = table(spark, base, "workshop", "record_id", "affiliations").where("trim(affiliations) <> ''")
    kept, dropped = X.list_items_kept(F.col("affiliations")), X.list_items(F.col("affiliations"))
    return w.select("record_id", F.size(kept).alias("places"), F.size(dropped).alias("filled"), F.coalesce(F.get(kept, F.lit(1)), F.lit("")).alias("second_kept"))


@query("SELECT authorship_id, metadata IS NULL OR coalesce(json_valid(metadata) AND starts_with(ltrim(metadata), '{') AND octet_length(encode(metadata)) <= 4096, false) valid FROM authorships")
def metadata_checks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "authorships", "authorship_id", "metadata").select("authorship_id", V.metadata_ok(F.col("metadata")).alias("valid"))
