"""Lookups, filtered lists and the assembled pages of authors and conferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.functions import validate as V
from biblioweave.operators import linkage, search, statistics
from biblioweave.operators.ranks import numbered
from biblioweave.plans import silver
from biblioweave.plans.reference import _importer, _lexemes, _slug
from biblioweave.plans.registry import query
from biblioweave.plans.silver import SQL as SILVER
from biblioweave.sources.tables import table

# lookups


def one_of(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is the one value of ``wanted``, a table of one row and column; none for null."""
    return df.join(F.broadcast(wanted.toDF("wanted_")), F.col(key) == F.col("wanted_"), "left_semi")


@query("SELECT author_id, full_name, family_name, given_name, normalized_name, affiliation FROM authors WHERE author_id = (SELECT min(author_id) FROM authors)")
def author_by_id(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "full_name", "family_name", "given_name", "normalized_name", "affiliation")
    return one_of(a, "author_id", a.agg(F.min("author_id")))


_SLUGS = f"""b AS (SELECT author_id, full_name, created_at, coalesce(nullif(concat_ws('-', {_slug('family_name')}, {_slug('given_name')}), ''), {_slug('full_name')}, 'anon') base FROM authors),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_at, author_id) n FROM b), g AS (SELECT author_id, full_name, CASE WHEN n = 1 THEN base ELSE base || '-' || n END slug FROM n)"""


@query(f"WITH {_SLUGS} SELECT author_id, full_name, slug FROM g WHERE slug = (SELECT max(slug) FROM g)")
def author_by_slug(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors")
    slugs = linkage.assign_slugs(a).join(a.select("author_id", "full_name"), "author_id").select("author_id", "full_name", "slug")
    return one_of(slugs, "slug", slugs.agg(F.max("slug")))


def picked(authors: DataFrame, text: str) -> DataFrame:
    """Authors whose full or normalized name holds ``text`` in any letter case; an empty text matches all."""
    pattern = f"%{text}%"
    return authors.where(F.col("full_name").ilike(pattern) | F.col("normalized_name").ilike(pattern))


@query("""SELECT 'some' kind, count(*) n, min(full_name) first_name FROM authors WHERE full_name ILIKE '%el%' OR normalized_name ILIKE '%el%'
UNION ALL SELECT 'all', count(*), min(full_name) FROM authors WHERE full_name IS NOT NULL OR normalized_name IS NOT NULL""")
def author_picker(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "full_name", "normalized_name")
    some = lambda text, kind: picked(a, text).agg(F.count("*").alias("n"), F.min("full_name").alias("first_name")).select(F.lit(kind).alias("kind"), "n", "first_name")
    return some("el", "some").union(some("", "all"))


# filters of lists and which of them counts


def authorships_by(s: DataFrame, publication: DataFrame | None = None, author: DataFrame | None = None) -> DataFrame:
    """Authorships of a publication, of an author, of both, or all; the wanted ids are tables of one row."""
    for key, wanted in (("publication_id", publication), ("author_id", author)):
        s = s if wanted is None else one_of(s, key, wanted)
    return s


@query("""WITH w AS (SELECT publication_id p, author_id a FROM authorships WHERE author_id IS NOT NULL AND publication_id IS NOT NULL ORDER BY authorship_id LIMIT 1)
SELECT 'both' asked, authorship_id, author_position::BIGINT author_position FROM authorships, w WHERE publication_id = p AND author_id = a
UNION ALL SELECT 'publication', authorship_id, author_position FROM authorships, w WHERE publication_id = p UNION ALL SELECT 'author', authorship_id, author_position FROM authorships, w WHERE author_id = a""")
def authorship_filters(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "authorships", "authorship_id", "publication_id", "author_id", "author_position")
    first = s.where("author_id is not null and publication_id is not null").orderBy("authorship_id").limit(1)
    p, a = first.select("publication_id"), first.select("author_id")
    parts = (("both", authorships_by(s, p, a)), ("publication", authorships_by(s, p)), ("author", authorships_by(s, None, a)))
    return statistics.union_all([d.select(F.lit(k).alias("asked"), "authorship_id", "author_position") for k, d in parts])


def publications_by(p: DataFrame, text: str | None = None, conference: Column | None = None) -> DataFrame:
    """Publications found by ``text``, else of ``conference``, else all: with a text the conference isn't asked for; other filters are ignored."""
    if text:
        stems = search.stemmed(p.withColumn("words_", search.lexemes(F.col("title"))), "words_", "stems_")
        return stems.where(search.matches(F.col("stems_"), text)).drop("words_", "stems_")
    return p if conference is None else p.where(F.col("conference_id") == conference)


@query(f"""WITH c AS (SELECT min(conference_id) c FROM publications), w AS (SELECT publication_id, conference_id, {_lexemes('title')} l FROM publications)
SELECT 'text' asked, publication_id FROM w WHERE list_has_any(l, ['code', 'codes', 'coded', 'coding']) UNION ALL SELECT 'conference', publication_id FROM publications, c WHERE conference_id = c""")
def publication_filter_order(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "publications", "publication_id", "conference_id", "title")
    first = p.agg(F.min("conference_id")).first()[0]  # one row
    both = publications_by(p, "codes", F.lit(first)).select(F.lit("text").alias("asked"), "publication_id")
    return both.union(publications_by(p, None, F.lit(first)).select(F.lit("conference"), "publication_id"))


def roles_by(roles: DataFrame, conference: DataFrame | None = None, author: DataFrame | None = None) -> DataFrame:
    """Committee roles of a conference, else of an author, else all; with a conference the author isn't asked for."""
    if conference is not None:
        return one_of(roles, "conference_id", conference)
    return roles if author is None else one_of(roles, "author_id", author)


@query(SILVER + """, c AS (SELECT min(conference_id) c FROM s_roles), a AS (SELECT min(author_id) a FROM s_roles)
SELECT 'conference' asked, role_id, row_number() OVER (ORDER BY list_position(['OC','PC','SC','Local'], committee) NULLS LAST, list_position(['chair','co_chair','area_chair','member'], position), role_title NULLS LAST, role_id) place FROM s_roles, c WHERE conference_id = c
UNION ALL SELECT 'author', role_id, row_number() OVER (ORDER BY role_id) FROM s_roles, a WHERE author_id = a""")
def committee_filter_order(spark: SparkSession, base: str) -> DataFrame:
    r = silver.roles(spark, base)
    c, a = r.agg(F.min("conference_id").alias("conference_id")), r.agg(F.min("author_id").alias("author_id"))
    order = [V.ordinal(F.col("committee"), V.COMMITTEE_TYPES).asc_nulls_last(), V.ordinal(F.col("position"), V.POSITIONS), F.asc_nulls_last("role_title"), F.asc("role_id")]
    first = numbered(roles_by(r, c, a).withColumn("asked", F.lit("conference")), ["asked"], order, "place").select("asked", "role_id", "place")
    return first.union(numbered(roles_by(r, None, a).withColumn("asked", F.lit("author")), ["asked"], [F.col("role_id")], "place").select("asked", "role_id", "place"))


def with_archive(conferences: DataFrame, columns: list[str], venue: str | None = None, year: int | None = None) -> DataFrame:
    """Conferences with a link in one of the columns, of a venue and a year where these are given."""
    found = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns]).isNotNull()
    for column, value in (("venue", venue), ("year", year)):
        found = found if value is None else found & (F.col(column) == value)
    return conferences.where(found)


@query("SELECT venue, year::BIGINT AS year, coalesce(nullif(trim(website_url), ''), nullif(trim(venue_name), '')) link FROM conferences WHERE venue = 'QIP' AND (nullif(trim(website_url), '') IS NOT NULL OR nullif(trim(venue_name), '') IS NOT NULL)")
def archive_sources(spark: SparkSession, base: str) -> DataFrame:
    from biblioweave.sources.files import first_url

    c = table(spark, base, "conferences", "venue", "year", "website_url", "venue_name")
    return with_archive(c, ["website_url", "venue_name"], "QIP").select("venue", "year", first_url("website_url", "venue_name").alias("link"))


# orders


@query("SELECT author_id, full_name, row_number() OVER (ORDER BY full_name NULLS LAST, author_id) place FROM authors")
def authors_by_name(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "full_name").withColumn("all_", F.lit(1))
    return numbered(a, ["all_"], [F.asc_nulls_last("full_name"), F.asc("author_id")], "place").select("author_id", "full_name", "place")


@query("SELECT record_id, venue, year::BIGINT AS year, row_number() OVER (PARTITION BY venue, year ORDER BY session_name NULLS LAST, title NULLS LAST, record_id) place FROM workshop")
def papers_by_session(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "venue", "year", "session_name", "title")
    return numbered(w, ["venue", "year"], [F.asc_nulls_last("session_name"), F.asc_nulls_last("title"), F.asc("record_id")], "place").select("record_id", "venue", "year", "place")


@query(SILVER + """SELECT a.author_id, a.publication_id, row_number() OVER (PARTITION BY a.author_id ORDER BY p.year DESC, p.venue, a.publication_id) - 1 row_index FROM s_authorships a JOIN s_pubs p ON p.publication_id = a.publication_id WHERE p.conference_id IS NOT NULL""")
def author_papers_by_year(spark: SparkSession, base: str) -> DataFrame:
    p = silver.publications(spark, base).where("conference_id is not null").select("publication_id", "venue", "year")
    d = silver.authorships(spark, base).select("author_id", "publication_id").join(p, "publication_id")
    return numbered(d, ["author_id"], [F.desc("year"), F.asc("venue"), F.asc("publication_id")], "n_").select("author_id", "publication_id", (F.col("n_") - 1).alias("row_index"))


# the page of an author: the one with most papers


def _named(spark: SparkSession, base: str) -> DataFrame:
    return silver.authors(spark, base).select("author_id", "full_name", F.coalesce(N.slugify(F.col("full_name")), F.lit("anon")).alias("slug"))


def _presenters(spark: SparkSession, base: str) -> DataFrame:
    from biblioweave.plans.reference import presenter_set

    return presenter_set(spark, base)


def _most_papers(spark: SparkSession, base: str) -> DataFrame:
    return silver.authorships(spark, base).groupBy("author_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author_id").limit(1).select("author_id")


_ONE = "one AS (SELECT author_id one_id FROM s_authorships GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_NAMED = f"named AS (SELECT author_id, full_name, coalesce({_slug('full_name')}, 'anon') slug FROM s_authors)"


@query(SILVER + f""", {_ONE}, {_NAMED}, d AS (SELECT s.*, c.venue, c.year FROM s_seen s JOIN one ON one_id = s.author_id LEFT JOIN conferences c ON c.conference_id = s.conference_id)
SELECT n.author_id, n.slug, n.full_name, CASE len(string_split({silver.sql_collapse('n.full_name')}, ' ')) WHEN 1 THEN upper({silver.sql_collapse('n.full_name')}[1:2]) ELSE upper({silver.sql_collapse('n.full_name')}[1]) || upper(string_split({silver.sql_collapse('n.full_name')}, ' ')[-1][1]) END initials,
count(DISTINCT publication_id) publication_count, count(DISTINCT role_id) committee_role_count, coalesce(array_to_string(list_sort(list_distinct(list(venue) FILTER (WHERE venue IS NOT NULL))), ', '), '') venues, coalesce(min(year)::VARCHAR, '') first_year, coalesce(max(year)::VARCHAR, '') last_year
FROM named n JOIN one ON one_id = n.author_id LEFT JOIN d ON d.author_id = n.author_id GROUP BY ALL""")
def author_page(spark: SparkSession, base: str) -> DataFrame:
    """Head of the page: names, counts and years, empty texts where there is nothing."""
    one = _most_papers(spark, base)
    seen = one_of(statistics.appearances(silver.authorships(spark, base), silver.publications(spark, base), silver.roles(spark, base)), "author_id", one)
    who = one_of(_named(spark, base), "author_id", one)
    stats = statistics.author_stats(who.withColumn("affiliation", F.lit(None).cast("string")), seen, table(spark, base, "conferences", "conference_id", "venue", "year"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return who.join(stats, "author_id").select("author_id", "slug", "full_name", N.display_initials(F.col("full_name")).alias("initials"), "publication_count", "committee_role_count", F.coalesce(F.array_join("venues", ", "), F.lit("")).alias("venues"), text("first_year"), text("last_year"))


@query(SILVER + f""", {_ONE}, {_NAMED}, o AS (SELECT publication_id, {{items}} sp FROM s_rows), k AS (SELECT publication_id, {{importer_sp}} k FROM o WHERE len(sp) = 1),
m AS (SELECT publication_id, md5(name_key) author_id, {{importer_name}} k FROM s_mentions WHERE name_key <> ''),
pr AS (SELECT k.publication_id, min(m.author_id) presenter FROM k JOIN m ON m.publication_id = k.publication_id AND m.k = k.k AND k.k <> '' GROUP BY 1 HAVING count(DISTINCT m.author_id) = 1),
mine AS (SELECT p.publication_id, p.title, p.venue, p.year, p.paper_type FROM s_authorships a JOIN one ON one_id = a.author_id JOIN s_pubs p ON p.publication_id = a.publication_id WHERE p.conference_id IS NOT NULL),
co AS (SELECT a.publication_id, string_agg(n.slug || '|' || n.full_name || '|' || coalesce(a.author_id = pr.presenter, false), '; ' ORDER BY a.author_position, a.author_id) coauthors FROM s_authorships a JOIN mine ON mine.publication_id = a.publication_id JOIN named n ON n.author_id = a.author_id LEFT JOIN pr ON pr.publication_id = a.publication_id WHERE a.author_id <> (SELECT one_id FROM one) GROUP BY 1)
SELECT mine.publication_id, row_number() OVER (ORDER BY year DESC, venue, mine.publication_id) place, title, lower(venue) || '-' || year conference_slug, CASE WHEN paper_type = 'poster' THEN 'posters' ELSE 'talks' END AS section, coalesce(coauthors, '') coauthors, coalesce(pr.presenter = (SELECT one_id FROM one), false) presenter_is_self
FROM mine LEFT JOIN co ON co.publication_id = mine.publication_id LEFT JOIN pr ON pr.publication_id = mine.publication_id""".replace("{items}", silver.sql_items("speakers")).replace("{importer_sp}", _importer("sp[1]")).replace("{importer_name}", _importer("name")))
def author_page_papers(spark: SparkSession, base: str) -> DataFrame:
    """Talks and posters of the author in the page's order, coauthors with slug and whether they speak."""
    one = _most_papers(spark, base)
    every = silver.authorships(spark, base)
    mine = one_of(every, "author_id", one).select("publication_id").join(silver.publications(spark, base).where("conference_id is not null").select("publication_id", "title", "venue", "year", "paper_type"), "publication_id")
    speaks = _presenters(spark, base)
    others = every.join(mine.select("publication_id"), "publication_id", "left_semi").join(F.broadcast(one.toDF("one_")), F.col("author_id") == F.col("one_"), "left_anti")
    people = statistics.author_lists(others, _named(spark, base), speaks)
    shown = F.array_join(F.transform("people", lambda p: F.concat_ws("|", p["slug"], p["name"], p["is_speaker"].cast("string"))), "; ")
    whole = mine.join(people, "publication_id", "left").join(speaks, "publication_id", "left").crossJoin(F.broadcast(one.toDF("one_")))  # one row
    rows = whole.withColumn("section", F.when(F.col("paper_type") == "poster", "posters").otherwise("talks"))
    placed = numbered(rows, ["one_"], [F.desc("year"), F.asc("venue"), F.asc("publication_id")], "place")
    return placed.select("publication_id", "place", "title", N.make_slug(F.col("venue"), F.col("year")).alias("conference_slug"), "section", F.coalesce(shown, F.lit("")).alias("coauthors"), F.coalesce(F.col("presenter_author_id") == F.col("one_"), F.lit(False)).alias("presenter_is_self"))


@query(SILVER + f""", {_ONE}, {_NAMED}, m AS (SELECT DISTINCT publication_id p, author_id a FROM s_authorships), e AS (SELECT y.a partner, count(*) joint FROM m x JOIN one ON one_id = x.a JOIN m y ON y.p = x.p AND y.a <> x.a GROUP BY 1)
SELECT slug, full_name, joint, row_number() OVER (ORDER BY joint DESC, full_name, author_id) place FROM e JOIN named ON author_id = partner QUALIFY place <= 20""")
def author_page_coauthors(spark: SparkSession, base: str) -> DataFrame:
    """The twenty most frequent coauthors of the author."""
    one, m = _most_papers(spark, base), silver.authorships(spark, base).select("publication_id", "author_id")
    mine = one_of(m, "author_id", one).select("publication_id")
    joint = m.join(mine, "publication_id", "left_semi").join(F.broadcast(one.toDF("one_")), F.col("author_id") == F.col("one_"), "left_anti").groupBy("author_id").agg(F.count("*").alias("joint"))
    named = joint.join(_named(spark, base), "author_id").orderBy(F.desc("joint"), "full_name", "author_id").limit(20).withColumn("all_", F.lit(1))
    return numbered(named, ["all_"], [F.desc("joint"), F.asc("full_name"), F.asc("author_id")], "place").select("slug", "full_name", "joint", "place")


# the contribution graph: all authors

#: Measures of the graph in pixels (fixed values).
COLUMN, PAPER, PAPER_STEP, GLYPH_STEP, BAND, TOP = 28, 12, 14, 18, 16, 10


@query(SILVER + f""", d AS (SELECT author_id, conference_id, year, venue, committee, position, role_id FROM s_roles WHERE conference_id IS NOT NULL),
t AS (SELECT a.author_id, p.year, count(*) n FROM s_authorships a JOIN s_pubs p ON p.publication_id = a.publication_id WHERE p.conference_id IS NOT NULL AND p.paper_type IS DISTINCT FROM 'poster' GROUP BY 1, 2),
y AS (SELECT author_id, min(year) first_year, max(papers) most_papers FROM (SELECT author_id, year, n papers FROM t UNION ALL SELECT author_id, year, 0 FROM d) GROUP BY 1),
s AS (SELECT d.*, row_number() OVER (PARTITION BY author_id, year ORDER BY coalesce(list_position(['OC','PC','SC','Local'], committee), 5), CASE WHEN position IN ('chair', 'co_chair') THEN 0 ELSE 1 END, role_id) - 1 stack FROM d)
SELECT s.author_id, role_id, stack, ((s.year - first_year) * {COLUMN} + {COLUMN // 2} + 2)::BIGINT cx, ({TOP} + most_papers * {PAPER_STEP} + {BAND} + stack * {GLYPH_STEP})::BIGINT cy, CASE WHEN position IN ('chair', 'co_chair') THEN 'leads' ELSE 'serves' END AS standing,
venue || ' ' || s.year || ' — ' || coalesce(committee, '') || ' · ' || CASE position WHEN 'chair' THEN 'Chair' WHEN 'co_chair' THEN 'Co-Chair' WHEN 'area_chair' THEN 'Area Chair' ELSE 'Member' END tooltip FROM s JOIN y ON y.author_id = s.author_id""")
def contribution_glyphs(spark: SparkSession, base: str) -> DataFrame:
    """The committee marks of every author's graph: stacks by committee and leadership, coordinates below the papers."""
    roles = silver.roles(spark, base).where("conference_id is not null")
    p = silver.publications(spark, base).where("conference_id is not null and (paper_type is null or paper_type <> 'poster')").select("publication_id", "year")
    papers = silver.authorships(spark, base).join(p, "publication_id").groupBy("author_id", "year").agg(F.count("*").alias("n"))
    span = papers.union(roles.select("author_id", "year", F.lit(0))).groupBy("author_id").agg(F.min("year").alias("first_year"), F.max("n").alias("most_papers"))
    leads = F.col("position").isin("chair", "co_chair")
    order = [F.coalesce(V.ordinal(F.col("committee"), V.COMMITTEE_TYPES), F.lit(4)), F.when(leads, 0).otherwise(1), F.col("role_id")]
    stacked = numbered(roles, ["author_id", "year"], order, "n_").withColumn("stack", F.col("n_") - 1).join(span, "author_id")
    word = F.when(F.col("position") == "chair", "Chair").when(F.col("position") == "co_chair", "Co-Chair").when(F.col("position") == "area_chair", "Area Chair").otherwise("Member")
    tip = F.concat(F.col("venue"), F.lit(" "), F.col("year").cast("string"), F.lit(" — "), F.coalesce("committee", F.lit("")), F.lit(" · "), word)
    cx, cy = (F.col("year") - F.col("first_year")) * COLUMN + COLUMN // 2 + 2, TOP + F.col("most_papers") * PAPER_STEP + BAND + F.col("stack") * GLYPH_STEP
    return stacked.select("author_id", "role_id", "stack", cx.cast("long").alias("cx"), cy.cast("long").alias("cy"), F.when(leads, "leads").otherwise("serves").alias("standing"), tip.alias("tooltip"))


# the page of a conference: all of them


@query(SILVER + f""", {_NAMED}, l AS (SELECT a.publication_id, string_agg(n.slug || '|' || n.full_name, '; ' ORDER BY a.author_position, a.author_id) people FROM s_authorships a JOIN named n ON n.author_id = a.author_id GROUP BY 1)
SELECT p.venue, p.year::BIGINT AS year, p.publication_id, row_number() OVER (PARTITION BY p.venue, p.year ORDER BY coalesce(nullif(p.scheduled_date, ''), '9999-12-31'), coalesce(nullif(p.scheduled_time, ''), '23:59:59'), list_position(['regular','poster','invited','tutorial','keynote','plenary','plenary_short','plenary_long','industry'], paper_type) NULLS LAST, title NULLS LAST, p.publication_id) place, coalesce(l.people, '') people,
coalesce(CASE WHEN regexp_full_match(trim(scheduled_time), '\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?') AND try_cast(split_part(trim(scheduled_time), ':', 1) AS INT) < 24 AND try_cast(split_part(trim(scheduled_time), ':', 2) AS INT) < 60 AND coalesce(try_cast(nullif(split_part(trim(scheduled_time), ':', 3), '') AS INT), 0) < 60 THEN printf('%02d:%02d', split_part(trim(scheduled_time), ':', 1)::INT, split_part(trim(scheduled_time), ':', 2)::INT) END, '') AS clock
FROM s_pubs p LEFT JOIN l ON l.publication_id = p.publication_id WHERE p.conference_id IS NOT NULL""")
def conference_page_papers(spark: SparkSession, base: str) -> DataFrame:
    """The programme of every conference with the authors of each paper; times as hour and minute."""
    p = silver.publications(spark, base).where("conference_id is not null").select("publication_id", "venue", "year", "title", "paper_type", "scheduled_date", "scheduled_time")
    none = p.select("publication_id", F.lit(None).cast("string").alias("presenter_author_id"))
    lists = statistics.author_lists(silver.authorships(spark, base), _named(spark, base), none)
    order = [F.coalesce(F.nullif("scheduled_date", F.lit("")), F.lit("9999-12-31")), F.coalesce(F.nullif("scheduled_time", F.lit("")), F.lit("23:59:59")), V.ordinal(F.col("paper_type"), V.PAPER_TYPES).asc_nulls_last(), F.asc_nulls_last("title"), F.asc("publication_id")]
    shown = F.array_join(F.transform("people", lambda x: F.concat_ws("|", x["slug"], x["name"])), "; ")
    placed = numbered(p, ["venue", "year"], order, "place").join(lists, "publication_id", "left")
    return placed.select("venue", "year", "publication_id", "place", F.coalesce(shown, F.lit("")).alias("people"), F.coalesce(F.substring(X.importer_time(F.col("scheduled_time")), 1, 5), F.lit("")).alias("clock"))


@query(f"""WITH p AS (SELECT conference_id, count(*) n, count(*) FILTER (WHERE paper_type = 'regular') r FROM publications GROUP BY 1)
SELECT lower(venue) || '-' || year slug, coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country_code, '')), ''), '-') AS location, coalesce(start_date::VARCHAR, '') start_day, coalesce(end_date::VARCHAR, '') end_day, coalesce(website_url, '') website_url, coalesce(n, 0) publication_count, coalesce(r, 0) regular_count
FROM conferences c LEFT JOIN p ON p.conference_id = c.conference_id""")
def conference_page(spark: SparkSession, base: str) -> DataFrame:
    """Heads of the conferences' pages."""
    c = table(spark, base, "conferences")
    p = table(spark, base, "publications", "conference_id", "paper_type").groupBy("conference_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("paper_type") == "regular", 1)).alias("r"))
    place = F.coalesce(F.nullif(F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("country_code", F.lit(""))), F.lit("")), F.lit("-"))
    text = lambda x, name: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(name)
    return c.join(p, "conference_id", "left").select(N.make_slug(F.col("venue"), F.col("year")).alias("slug"), place.alias("location"), text("start_date", "start_day"), text("end_date", "end_day"), text("website_url", "website_url"), F.coalesce("n", F.lit(0)).alias("publication_count"), F.coalesce("r", F.lit(0)).alias("regular_count"))
