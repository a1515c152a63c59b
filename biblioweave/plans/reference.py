"""Queries of listings, pages, statistics, linkage, matching, extraction and changes, each with its SQL where SQL states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.functions import validate as V
from biblioweave.operators import linkage, matching, mutate, search, statistics
from biblioweave.operators.ranks import numbered
from biblioweave.plans import registry, silver
from biblioweave.plans.registry import query
from biblioweave.plans.silver import SQL as SILVER
from biblioweave.plans.silver import sql_collapse, sql_fold, sql_items, sql_norm
from biblioweave.sources.tables import table

# coauthors


@query("""WITH m AS (SELECT DISTINCT publication_id p, author_id a FROM authorships WHERE publication_id IS NOT NULL AND author_id IS NOT NULL)
SELECT x.a author1_id, y.a author2_id, count(*) joint FROM m x JOIN m y ON x.p = y.p AND x.a < y.a GROUP BY ALL""")
def coauthor_pairs(spark: SparkSession, base: str) -> DataFrame:
    return statistics.coauthor_pairs(table(spark, base, "authorships", "publication_id", "author_id"))


@query("""WITH m AS (SELECT DISTINCT publication_id p, author_id a FROM authorships WHERE publication_id IS NOT NULL AND author_id IS NOT NULL),
e AS (SELECT x.a author_id, y.a partner_id, count(*) joint FROM m x JOIN m y ON x.p = y.p AND x.a <> y.a GROUP BY ALL)
SELECT e.author_id, row_number() OVER (PARTITION BY e.author_id ORDER BY joint DESC, full_name ASC NULLS LAST, partner_id) AS rank, partner_id, full_name partner_name, joint
FROM e JOIN authors a ON a.author_id = partner_id QUALIFY rank <= 20""")
def top_collaborators(spark: SparkSession, base: str) -> DataFrame:
    return statistics.top_collaborators(table(spark, base, "authorships", "publication_id", "author_id"), table(spark, base, "authors", "author_id", "full_name"))


# statistics


@query(SILVER + """, d AS (SELECT s.*, c.venue, c.year FROM s_seen s LEFT JOIN conferences c ON c.conference_id = s.conference_id),
r AS (SELECT author_id, affiliation FROM d WHERE affiliation IS NOT NULL AND affiliation <> ''
  QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY coalesce(year, -1) DESC, publication_id IS NOT NULL DESC, coalesce(publication_id, role_id)) = 1)
SELECT a.author_id, count(DISTINCT publication_id) publication_count, count(DISTINCT role_id) committee_role_count, count(DISTINCT CASE WHEN position IN ('chair', 'co_chair') THEN role_id END) leadership_count,
array_to_string(list_sort(list_distinct(list(venue) FILTER (WHERE venue IS NOT NULL))), ', ') venues, min(year)::BIGINT first_year, max(year)::BIGINT last_year, any_value(r.affiliation) recent_affiliation
FROM s_authors a LEFT JOIN d ON d.author_id = a.author_id LEFT JOIN r ON r.author_id = a.author_id GROUP BY a.author_id""")
def author_stats(spark: SparkSession, base: str) -> DataFrame:
    conf = table(spark, base, "conferences", "conference_id", "venue", "year")
    seen = statistics.appearances(silver.authorships(spark, base), silver.publications(spark, base), silver.roles(spark, base))
    return statistics.author_stats(silver.authors(spark, base), seen, conf).withColumn("venues", F.array_join("venues", ", "))


@query(f"""WITH p AS (SELECT conference_id, count(*) publication_count, count(*) FILTER (WHERE paper_type = 'regular') regular_count, count(*) FILTER (WHERE paper_type = 'invited') invited_count, count(award) award_count FROM publications GROUP BY 1),
u AS (SELECT p.conference_id, count(DISTINCT a.author_id) unique_author_count FROM publications p JOIN authorships s ON s.publication_id = p.publication_id JOIN authors a ON a.author_id = s.author_id GROUP BY 1),
r AS (SELECT venue, year, count(*) committee_member_count FROM committees GROUP BY 1, 2)
SELECT c.conference_id, c.venue, c.year::BIGINT AS year, c.submission_count::BIGINT submission_count, coalesce(publication_count, 0) publication_count, coalesce(regular_count, 0) regular_count, coalesce(invited_count, 0) invited_count, coalesce(award_count, 0) award_count,
coalesce(committee_member_count, 0) committee_member_count, coalesce(unique_author_count, 0) unique_author_count, regular_count acceptance_count,
CASE WHEN submission_count > 0 AND regular_count IS NOT NULL THEN floor((2000 * regular_count + submission_count) // (2 * submission_count)) / 10.0::DOUBLE END acceptance_rate
FROM conferences c LEFT JOIN p ON p.conference_id = c.conference_id LEFT JOIN u ON u.conference_id = c.conference_id LEFT JOIN r ON r.venue = c.venue AND r.year = c.year""")
def conference_stats(spark: SparkSession, base: str) -> DataFrame:
    """The tables hold no number of accepted papers; that of regular papers stands in for it."""
    conf = table(spark, base, "conferences", "conference_id", "venue", "year", "submission_count")
    pubs = table(spark, base, "publications", "publication_id", "conference_id", "paper_type", "award")
    roles = table(spark, base, "committees", "venue", "year").join(conf.select("conference_id", "venue", "year"), ["venue", "year"]).select("conference_id")
    accepted = pubs.groupBy("conference_id").agg(F.count(F.when(F.col("paper_type") == "regular", 1)).alias("acceptance_count"))
    out = statistics.conference_stats(conf.join(accepted, "conference_id", "left"), pubs, roles, table(spark, base, "authorships", "publication_id", "author_id"), table(spark, base, "authors", "author_id"))
    return out.withColumn("acceptance_rate", F.col("acceptance_rate").cast("double"))


@query("SELECT (SELECT count(*) FROM conferences) conferences, (SELECT count(*) FROM authors) authors, (SELECT count(*) FROM publications) publications, (SELECT count(*) FROM committees) committee_roles")
def home_totals(spark: SparkSession, base: str) -> DataFrame:
    one = [table(spark, base, n).agg(F.count("*").alias(a)) for n, a in (("conferences", "conferences"), ("authors", "authors"), ("publications", "publications"), ("committees", "committee_roles"))]
    return one[0].join(one[1]).join(one[2]).join(one[3])


@query(SILVER + """, d AS (SELECT s.author_id, s.publication_id, s.role_id, c.venue, c.year FROM s_seen s JOIN conferences c ON c.conference_id = s.conference_id LEFT JOIN s_pubs p ON p.publication_id = s.publication_id
  WHERE s.publication_id IS NULL OR p.paper_type IS NULL OR p.paper_type <> 'poster'),
per AS (SELECT author_id, year, count(DISTINCT publication_id) papers, count(DISTINCT role_id) roles, count(DISTINCT CASE WHEN venue = 'QIP' THEN publication_id END) qip, count(DISTINCT CASE WHEN venue = 'QCRYPT' THEN publication_id END) qcrypt, count(DISTINCT CASE WHEN venue = 'TQC' THEN publication_id END) tqc FROM d GROUP BY 1, 2),
span AS (SELECT author_id, unnest(generate_series(min(year), max(year))) AS year FROM per GROUP BY 1)
SELECT s.author_id, s.year::BIGINT AS year, coalesce(papers, 0) papers, coalesce(roles, 0) roles, coalesce(qip, 0) qip, coalesce(qcrypt, 0) qcrypt, coalesce(tqc, 0) tqc FROM span s LEFT JOIN per USING (author_id, year)""")
def contribution_timeline(spark: SparkSession, base: str) -> DataFrame:
    pubs = silver.publications(spark, base)
    seen = statistics.appearances(silver.authorships(spark, base), pubs, silver.roles(spark, base))
    return statistics.timeline(seen, pubs, table(spark, base, "conferences", "conference_id", "venue", "year"))


_COVER = ("scheduled_date", "scheduled_time", "video_url", "youtube_id", "abstract", "arxiv_ids")


@query(f"SELECT venue, year::BIGINT AS year, count(*) n_rows, {', '.join(f'count(nullif({c}, {chr(39)*2})) n_{c}' for c in _COVER)} FROM workshop GROUP BY 1, 2")
def coverage_inventory(spark: SparkSession, base: str) -> DataFrame:
    return statistics.coverage(table(spark, base, "workshop", "venue", "year", *_COVER), ["venue", "year"], *_COVER)


# listings and pages


@query("SELECT venue, year::BIGINT AS year, lower(venue) || '-' || year slug FROM conferences ORDER BY year DESC, venue LIMIT 10")
def recent_conferences(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "conferences", "venue", "year")
    return c.orderBy(F.desc("year"), "venue").limit(10).withColumn("slug", N.make_slug(F.col("venue"), F.col("year")))


@query("""SELECT venue, year::BIGINT AS year, coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country_code, '')), ''), '-') AS location, CASE WHEN submission_count > 0 THEN submission_count || ' submissions' ELSE 'unknown' END submissions
FROM conferences WHERE venue IN ('QIP', 'TQC')""")
def conference_list_filtered(spark: SparkSession, base: str) -> DataFrame:
    wanted = "QIP,TQC"
    c = table(spark, base, "conferences", "venue", "year", "city", "country_code", "submission_count")
    if wanted:
        c = c.where(F.col("venue").isin(*wanted.split(",")))
    place = F.coalesce(F.nullif(F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("country_code", F.lit(""))), F.lit("")), F.lit("-"))
    text = F.when(F.col("submission_count") > 0, F.concat(F.col("submission_count").cast("string"), F.lit(" submissions"))).otherwise("unknown")
    return c.orderBy(F.desc("year"), "venue").select("venue", "year", place.alias("location"), text.alias("submissions"))


@query("SELECT author_id, full_name, affiliation FROM authors WHERE full_name ILIKE '%an%' OR normalized_name ILIKE '%an%' OR family_name ILIKE '%an%' OR affiliation ILIKE '%an%'")
def author_search_ilike(spark: SparkSession, base: str) -> DataFrame:
    pattern = "%an%"
    hit = F.col("full_name").ilike(pattern) | F.col("normalized_name").ilike(pattern) | F.col("family_name").ilike(pattern) | F.col("affiliation").ilike(pattern)
    return table(spark, base, "authors").where(hit).select("author_id", "full_name", "affiliation")


@query("SELECT author_id, full_name, family_name, given_name FROM authors ORDER BY family_name ASC NULLS LAST, given_name ASC NULLS LAST, author_id LIMIT 100 OFFSET 50")
def author_list_paged(spark: SparkSession, base: str) -> DataFrame:
    ordered = table(spark, base, "authors", "author_id", "full_name", "family_name", "given_name").orderBy(F.asc_nulls_last("family_name"), F.asc_nulls_last("given_name"), "author_id")
    return V.page(ordered, None, 50)


@query("SELECT publication_id, title, coalesce(award, '') award, coalesce(duration_minutes, 0)::BIGINT duration_minutes FROM publications ORDER BY created_at DESC, publication_id LIMIT 1000")
def publication_list_paged(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "publications", "publication_id", "title", "award", "duration_minutes", "created_at").orderBy(F.desc("created_at"), "publication_id")
    return V.page(p, 5000).select("publication_id", "title", F.coalesce("award", F.lit("")).alias("award"), F.coalesce("duration_minutes", F.lit(0)).alias("duration_minutes"))


@query("""SELECT p.publication_id, c.venue, c.year::BIGINT AS year, p.title, array_to_string(coalesce(p.arxiv_ids, []), ';') arxiv_ids, coalesce(p.doi, '') doi
FROM publications p JOIN conferences c ON c.conference_id = p.conference_id WHERE lower(c.venue) || '-' || c.year = 'qip-2013'""")
def publication_by_conference(spark: SparkSession, base: str) -> DataFrame:
    conf = table(spark, base, "conferences", "conference_id", "venue", "year")
    wanted = spark.range(1).select(N.conference_slug(F.lit("qip-2013")).alias("s"))
    one = conf.join(F.broadcast(wanted), (F.col("venue") == F.col("s.venue")) & (F.col("year") == F.col("s.year")))
    p = table(spark, base, "publications", "publication_id", "conference_id", "title", "arxiv_ids", "doi").join(one, "conference_id")
    return p.select("publication_id", "venue", "year", "title", F.array_join(F.coalesce("arxiv_ids", F.array().cast("array<string>")), ";").alias("arxiv_ids"), F.coalesce("doi", F.lit("")).alias("doi")).orderBy("title", "publication_id")


@query("""SELECT venue, year::BIGINT AS year, record_id, row_number() OVER (PARTITION BY venue, year ORDER BY coalesce(nullif(scheduled_date, ''), '9999-12-31'), coalesce(nullif(scheduled_time, ''), '23:59:59'),
list_position(['regular','poster','invited','tutorial','keynote','plenary','plenary_short','plenary_long','industry'], paper_type) ASC NULLS LAST, title ASC NULLS LAST, record_id) place FROM workshop""")
def conference_program_sorted(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "venue", "year", "record_id", "scheduled_date", "scheduled_time", "paper_type", "title")
    order = [F.coalesce(F.nullif("scheduled_date", F.lit("")), F.lit("9999-12-31")), F.coalesce(F.nullif("scheduled_time", F.lit("")), F.lit("23:59:59")), V.ordinal(F.col("paper_type"), V.PAPER_TYPES).asc_nulls_last(), F.asc_nulls_last("title"), F.asc("record_id")]
    return numbered(w, ["venue", "year"], order, "place").select("venue", "year", "record_id", "place")


@query("""SELECT publication_id, string_agg(full_name, '; ' ORDER BY author_position, authorship_id) authors FROM authorships s JOIN authors a ON a.author_id = s.author_id WHERE publication_id IS NOT NULL GROUP BY 1""")
def publication_ordered_authors(spark: SparkSession, base: str) -> DataFrame:
    return statistics.ordered_authors(table(spark, base, "authorships", "authorship_id", "publication_id", "author_id", "author_position"), table(spark, base, "authors", "author_id", "full_name"))


@query("""WITH m AS (SELECT publication_id, author_id, min(author_position) pos FROM authorships WHERE publication_id IS NOT NULL AND author_id IS NOT NULL GROUP BY 1, 2)
SELECT x.publication_id, x.author_id, count(y.author_id) coauthors, min(y.pos)::BIGINT first_position FROM m x LEFT JOIN m y ON y.publication_id = x.publication_id AND y.author_id <> x.author_id GROUP BY 1, 2""")
def publication_coauthors_excluding_self(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "authorships", "publication_id", "author_id", "author_position").where("publication_id is not null and author_id is not null").groupBy("publication_id", "author_id").agg(F.min("author_position").alias("pos"))
    # others of a publication: its number of authors less one, and the least place among the others, from the two least places
    per = m.groupBy("publication_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "author_id"))), 1, 2).alias("two"))
    other = F.when(F.col("two")[0]["author_id"] == F.col("author_id"), F.get("two", F.lit(1))["pos"]).otherwise(F.col("two")[0]["pos"])
    return m.join(per, "publication_id").select("publication_id", "author_id", (F.col("n") - 1).alias("coauthors"), other.alias("first_position"))


@query(SILVER + """SELECT venue, year::BIGINT AS year, committee, row_number() OVER (PARTITION BY venue, year, committee ORDER BY list_position(['chair','co_chair','area_chair','member'], position), full_name, role_id) place, position, full_name, role_id FROM s_roles""")
def committee_sections_enum_order(spark: SparkSession, base: str) -> DataFrame:
    order = [V.ordinal(F.col("position"), V.POSITIONS), F.col("full_name"), F.col("role_id")]
    return numbered(silver.roles(spark, base), ["venue", "year", "committee"], order, "place").select("venue", "year", "committee", "place", "position", "full_name", "role_id")


@query(SILVER + """SELECT author_id, row_number() OVER (PARTITION BY author_id ORDER BY year DESC, venue, list_position(['OC','PC','SC','Local'], committee) ASC NULLS LAST, role_id) place, venue, year::BIGINT AS year, committee, position, role_title FROM s_roles""")
def committee_by_author(spark: SparkSession, base: str) -> DataFrame:
    order = [F.desc("year"), F.asc("venue"), V.ordinal(F.col("committee"), V.COMMITTEE_TYPES).asc_nulls_last(), F.asc("role_id")]
    return numbered(silver.roles(spark, base), ["author_id"], order, "place").select("author_id", "place", "venue", "year", "committee", "position", "role_title")


@query(SILVER + f"""SELECT a.publication_id, a.author_id, coalesce({sql_norm('p.speakers')} = {sql_norm('a.name')}, false) is_speaker FROM s_authorships a JOIN s_pubs p ON p.publication_id = a.publication_id""")
def presenter_flags(spark: SparkSession, base: str) -> DataFrame:
    p = silver.publications(spark, base).select("publication_id", "speakers")
    same = F.coalesce(N.normalize_name(F.col("speakers")) == N.normalize_name(F.col("name")), F.lit(False))
    return silver.authorships(spark, base).join(p, "publication_id").select("publication_id", "author_id", same.alias("is_speaker"))


@query(f"""WITH t AS (SELECT talk_id, speaker, {sql_norm('speaker')} k FROM talks WHERE speaker IS NOT NULL AND trim(speaker) <> ''),
a AS (SELECT talk_id, {sql_norm('unnest(' + sql_items('authors') + ')')} k FROM talks)
SELECT talk_id, speaker FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.talk_id = t.talk_id AND a.k = t.k)""")
def presenter_violations_anti(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "talks", "talk_id", "speaker", "authors")
    said = t.where(F.trim("speaker") != "").select("talk_id", "speaker", N.normalize_name(F.col("speaker")).alias("k"))
    listed = t.select("talk_id", F.explode(X.list_items(F.col("authors"))).alias("name")).select("talk_id", N.normalize_name(F.col("name")).alias("k"))
    return said.join(listed, ["talk_id", "k"], "left_anti").select("talk_id", "speaker")


# names


def _slug(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({sql_fold(x)}), '[^a-z0-9]+', '-', 'g'), '-'), '')"


def _loose(x: str) -> str:
    return sql_collapse(f"regexp_replace({sql_norm(x)}, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')")


@query(f"""WITH b AS (SELECT author_id, created_at, coalesce(nullif(concat_ws('-', {_slug('family_name')}, {_slug('given_name')}), ''), {_slug('full_name')}, 'anon') base FROM authors),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_at, author_id) n FROM b)
SELECT author_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END slug FROM n""")
def author_slugs_row_number(spark: SparkSession, base: str) -> DataFrame:
    return linkage.assign_slugs(table(spark, base, "authors"))


@query(f"SELECT author_id, {sql_norm('full_name')} AS name_key, {_loose('full_name')} loose_key FROM authors")
def normalized_names(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "authors", "author_id", "full_name").select("author_id", N.normalize_name(F.col("full_name")).alias("name_key"), N.normalize_loose(F.col("full_name")).alias("loose_key"))


@query(f"""WITH w AS (SELECT author_id, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w FROM authors WHERE full_name IS NOT NULL)
SELECT author_id, array_to_string(list_transform(w, lambda x: upper(x[1])), '') initials, CASE len(w) WHEN 0 THEN '?' WHEN 1 THEN upper(w[1][1:2]) ELSE upper(w[1][1]) || upper(w[-1][1]) END shown FROM w""")
def name_initials(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "authors", "author_id", "full_name").where("full_name is not null").select("author_id", N.extract_initials(F.col("full_name")).alias("initials"), N.display_initials(F.col("full_name")).alias("shown"))


_PARTICLES = "[" + ", ".join(f"'{p}'" for p in N.PARTICLES) + "]"


@query(f"""WITH w AS (SELECT author_id, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w FROM authors WHERE full_name IS NOT NULL),
n AS (SELECT *, coalesce(list_max(list_filter(range(1, len(w)), lambda i: NOT list_contains({_PARTICLES}, lower(w[i])))), 0) h FROM w)
SELECT author_id, CASE WHEN len(w) > 1 AND h > 0 THEN array_to_string(w[1:h], ' ') END given, CASE WHEN len(w) > 0 THEN array_to_string(w[h + 1:], ' ') END family FROM n""")
def name_parts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "authors", "author_id", "full_name").where("full_name is not null").select("author_id", N.split_name(F.col("full_name")).alias("s")).select("author_id", "s.given", "s.family")


@query(f"""WITH p AS (SELECT authorship_id, {sql_norm('published_as_name')} x, {sql_norm('full_name')} y, published_as_name u, full_name v FROM authorships s JOIN authors a ON a.author_id = s.author_id WHERE published_as_name IS NOT NULL AND full_name IS NOT NULL),
q AS (SELECT *, list_distinct(list_filter(string_split(x, ' '), lambda t: t <> '')) a, list_distinct(list_filter(string_split(y, ' '), lambda t: t <> '')) b, trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) lx, trim(regexp_replace(y, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) ly FROM p)
SELECT authorship_id, CASE WHEN x = y THEN 1.0 WHEN lx = ly THEN 0.95 WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END::DOUBLE similarity FROM q""")
def name_similarity_pairs(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "authorships", "authorship_id", "author_id", "published_as_name").join(table(spark, base, "authors", "author_id", "full_name"), "author_id").where("published_as_name is not null and full_name is not null")
    return s.select("authorship_id", F.round(N.name_similarity(F.col("published_as_name"), F.col("full_name")), 6).alias("similarity"))


@query(f"""WITH s AS (SELECT member_id, {sql_norm('full_name')} k FROM committees WHERE full_name IS NOT NULL), g AS (SELECT k name_key, count(*) n, min(member_id) first_id FROM s WHERE k <> '' GROUP BY k HAVING count(*) > 1) SELECT * FROM g""")
def duplicate_author_groups(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "committees", "member_id", "full_name").select("member_id", N.normalize_name(F.col("full_name")).alias("name_key"))
    return c.where("name_key <> ''").groupBy("name_key").agg(F.count("*").alias("n"), F.min("member_id").alias("first_id")).where("n > 1").orderBy(F.desc("n"), "name_key")


def _importer(x: str) -> str:
    bare = f"regexp_replace({x}, '(?i)\\b(Dr|Prof|Jr|Sr|Ph\\.?D|M\\.?D)\\.?\\s*', ' ', 'g')"
    words = f"string_split({sql_collapse(f'lower({sql_fold(bare)})')}, ' ')"
    return f"array_to_string(list_filter({words}, lambda t: NOT regexp_full_match(t, '[a-z]\\.?')), ' ')"


@query(SILVER + f""", k AS (SELECT author_id, full_name, {_importer('full_name')} name_key, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w FROM s_authors),
r AS (SELECT *, len(w) b, list_bool_or(list_transform(w, lambda x: regexp_full_match(x, '.\\.')))::INT c, regexp_matches(full_name, '[^\\x00-\\x7f]')::INT d FROM k WHERE name_key <> ''),
t AS (SELECT *, first_value(author_id) OVER (PARTITION BY name_key ORDER BY b DESC, c DESC, d DESC, author_id) canonical_id FROM r)
SELECT author_id, canonical_id, name_key FROM t WHERE author_id <> canonical_id""")
def merge_plan_canonical(spark: SparkSession, base: str) -> DataFrame:
    return linkage.merge_plan(silver.authors(spark, base))


@query(SILVER + f""", k AS (SELECT author_id, full_name, {_importer('full_name')} name_key, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w FROM s_authors),
r AS (SELECT *, len(w) b, list_bool_or(list_transform(w, lambda x: regexp_full_match(x, '.\\.')))::INT c, regexp_matches(full_name, '[^\\x00-\\x7f]')::INT d FROM k WHERE name_key <> ''),
t AS (SELECT *, first_value(author_id) OVER (PARTITION BY name_key ORDER BY b DESC, c DESC, d DESC, author_id) canonical_id FROM r),
m AS (SELECT s.publication_id, coalesce(t.canonical_id, s.author_id) author_id, s.author_position, t.canonical_id IS NOT NULL AND t.canonical_id <> s.author_id moved FROM s_authorships s LEFT JOIN t ON t.author_id = s.author_id)
SELECT publication_id, author_id, author_position::BIGINT author_position FROM m QUALIFY row_number() OVER (PARTITION BY publication_id, author_id ORDER BY moved, author_position) = 1""")
def merged_authorships(spark: SparkSession, base: str) -> DataFrame:
    own = silver.authorships(spark, base).withColumn("authorship_id", F.col("author_position"))
    return linkage.merge_authorships(own, linkage.merge_plan(silver.authors(spark, base))).select("publication_id", "author_id", "author_position")


@query(f"""WITH m AS (SELECT member_id, full_name, affiliation, {sql_norm('full_name')} k FROM committees),
o AS (SELECT k name_key, arg_min(full_name, member_id) first_name, arg_max(affiliation, member_id) FILTER (WHERE trim(affiliation) <> '') affiliation FROM m WHERE k <> '' GROUP BY k),
a AS (SELECT {sql_norm('full_name')} k, min(author_id) id FROM authors GROUP BY 1)
SELECT name_key, coalesce(id, md5(name_key)) author_id, id IS NULL is_new, first_name, affiliation FROM o LEFT JOIN a ON a.k = name_key""")
def get_or_create_resolution(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "committees", "member_id", "full_name", "affiliation").select(F.col("full_name").alias("name"), "affiliation", F.col("member_id").alias("load_order"))
    return linkage.get_or_create(c, table(spark, base, "authors", "author_id", "full_name"))


@query(f"""WITH w AS (SELECT author_id, full_name, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w FROM authors WHERE full_name IS NOT NULL),
n AS (SELECT *, coalesce(list_max(list_filter(range(1, len(w)), lambda i: NOT list_contains({_PARTICLES}, lower(w[i])))), 0) h FROM w),
v AS (SELECT author_id, {sql_norm('full_name')} a, {_loose('full_name')} b, CASE WHEN len(w) > 0 THEN {sql_norm("array_to_string(w[h + 1:], ' ')")} END c, CASE WHEN len(w) > 1 AND h > 0 THEN lower(array_to_string(list_transform(w[1:h], lambda x: upper(x[1])), '')) || ' ' || {sql_norm("array_to_string(w[h + 1:], ' ')")} END d FROM n)
SELECT DISTINCT author_id, variant FROM (SELECT author_id, unnest([a, b, c, d]) variant FROM v) WHERE variant IS NOT NULL""")
def variants_exploded(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "full_name").where("full_name is not null")
    return a.select("author_id", F.explode(N.name_variants(F.col("full_name"))).alias("variant"))


# ingestion


@query("""SELECT record_id FROM workshop WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY venue, year, lower(trim(title)), coalesce(paper_type, ''), coalesce(scheduled_date, ''), coalesce(scheduled_time, '') ORDER BY record_id) = 1""")
def dedupe_keep_first(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "venue", "year", "title", "paper_type", "scheduled_date", "scheduled_time").where(F.trim("title") != "")
    keys = [F.col("venue"), F.col("year"), F.lower(F.trim("title")), *[F.coalesce(c, F.lit("")) for c in ("paper_type", "scheduled_date", "scheduled_time")]]
    return linkage.keep_first(w, keys, [F.col("record_id")]).select("record_id")


@query(SILVER + """, k AS (SELECT publication_id, src, venue || year || '-' || paper_type || '-' || row_number() OVER (PARTITION BY src, venue, year, paper_type ORDER BY rid) canonical_key FROM s_rows)
SELECT canonical_key, count(*) n, min(publication_id) first_id FROM k WHERE canonical_key IS NOT NULL GROUP BY 1""")
def canonical_keys(spark: SparkSession, base: str) -> DataFrame:
    keyed = linkage.canonical_keys(silver.rows(spark, base), "rid", F.col("src"))
    return keyed.where("canonical_key is not null").groupBy("canonical_key").agg(F.count("*").alias("n"), F.min("publication_id").alias("first_id"))


@query(SILVER + "SELECT publication_id, name, author_position::BIGINT author_position, affiliation FROM s_mentions WHERE name_key <> ''")
def semicolon_list_explode(spark: SparkSession, base: str) -> DataFrame:
    return silver.mentions(spark, base).select("publication_id", "name", "author_position", "affiliation")


@query("""WITH t AS (SELECT record_id, lower(concat_ws(' ', session_name, title)) x FROM workshop)
SELECT record_id, CASE WHEN contains(x, 'keynote') THEN 'keynote' WHEN contains(x, 'tutorial') THEN 'tutorial' WHEN contains(x, 'invited') OR contains(x, 'plenary') THEN 'invited' WHEN contains(x, 'poster') THEN 'poster' ELSE 'regular' END paper_type FROM t""")
def talk_type_classifier(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "workshop", "record_id", "session_name", "title").select("record_id", X.paper_type(F.col("session_name"), F.col("title")).alias("paper_type"))


@query("SELECT json_extract_string(metadata, '$.source_type') source_type, count(*) n, count(DISTINCT author_id) authors FROM authorships WHERE json_extract_string(metadata, '$.source_type') IS NOT NULL GROUP BY 1")
def json_metadata_filter(spark: SparkSession, base: str) -> DataFrame:
    kind = F.get_json_object("metadata", "$.source_type")
    return table(spark, base, "authorships", "author_id", "metadata").withColumn("source_type", kind).where("source_type is not null").groupBy("source_type").agg(F.count("*").alias("n"), F.count_distinct("author_id").alias("authors"))


@query("""SELECT member_id, CASE committee_type WHEN 'program' THEN 'PC' WHEN 'steering' THEN 'SC' WHEN 'local_organizing' THEN 'Local' WHEN 'organizing' THEN 'OC' ELSE committee_type END committee,
CASE lower(trim(position)) WHEN 'chair' THEN 'chair' WHEN 'co-chair' THEN 'co_chair' WHEN 'area_chair' THEN 'area_chair' ELSE 'member' END imported, CASE lower(trim(position)) WHEN 'chair' THEN 'chair' WHEN 'co-chair' THEN 'co_chair' WHEN 'co_chair' THEN 'co_chair' WHEN 'area_chair' THEN 'area_chair' ELSE 'member' END mended FROM committees""")
def committee_import(spark: SparkSession, base: str) -> DataFrame:
    p = F.col("position")
    return table(spark, base, "committees", "member_id", "committee_type", "position").select("member_id", X.committee_code(F.col("committee_type")).alias("committee"), X.position_code(p).alias("imported"), X.position_code(p, True).alias("mended"))


@query("""WITH t AS (SELECT record_id, regexp_extract(trim(scheduled_time), '^(\\d{1,2}):(\\d{2})(?::(\\d{2}))?$', ['h', 'm', 's']) x, regexp_extract(scheduled_time, '(\\d{1,2})[:.](\\d{2})', ['h', 'm']) y, duration_minutes FROM workshop)
SELECT record_id, CASE WHEN try_cast(x.h AS INT) < 24 AND try_cast(x.m AS INT) < 60 AND coalesce(try_cast(x.s AS INT), 0) < 60 THEN printf('%02d:%02d:%02d', try_cast(x.h AS INT), try_cast(x.m AS INT), coalesce(try_cast(x.s AS INT), 0)) END imported,
CASE WHEN try_cast(y.h AS INT) < 24 AND try_cast(y.m AS INT) < 60 THEN printf('%02d:%02d', try_cast(y.h AS INT), try_cast(y.m AS INT)) END loose,
CASE WHEN regexp_full_match(trim(duration_minutes), '\\d+') THEN trim(duration_minutes)::BIGINT END AS minutes FROM t""")
def importer_times(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("scheduled_time")
    return table(spark, base, "workshop", "record_id", "scheduled_time", "duration_minutes").select("record_id", X.importer_time(t).alias("imported"), X.loose_time(t).alias("loose"), X.duration(F.col("duration_minutes")).alias("minutes"))


@query("""SELECT venue, year::BIGINT AS year, record_id, last_value(nullif(session_name, '') IGNORE NULLS) OVER (PARTITION BY venue, year ORDER BY record_id ROWS UNBOUNDED PRECEDING) heading FROM workshop""")
def session_carry_forward(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "venue", "year", "record_id", "session_name")
    return matching.carry_forward(w, ["venue", "year"], "record_id", "session_name", "heading").drop("session_name")


@query("""WITH t AS (SELECT record_id, list_filter(list_transform(string_split(coalesce(notes, ''), ';'), lambda x: trim(x)), lambda x: x <> '') n, year FROM workshop)
SELECT record_id, concat_ws('; ', nullif(array_to_string(list_filter(n, lambda x: NOT (contains(x, '=') AND trim(split_part(x, '=', 1)) = 'yt_match')), '; '), ''), 'yt_match=' || year) notes FROM t""")
def notes_update(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "workshop", "record_id", "notes", "year").select("record_id", X.update_notes(F.col("notes"), {"yt_match": F.col("year")}).alias("notes"))


@query(None)
def arxiv_extract(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "arxiv_ids", "abstract")
    return w.select("record_id", F.array_join(X.arxiv_ids(F.concat_ws(" ", "arxiv_ids", "abstract")), ";").alias("ids")).where("ids <> ''")


@query("""WITH t AS (SELECT publication_id, list_distinct(list_transform(arxiv_ids, lambda x: regexp_replace(regexp_replace(trim(x), '^(?:https?://arxiv\\.org/(?:abs|pdf)/|arXiv:\\s*)', '', 'i'), 'v\\d+$', ''))) a FROM publications WHERE arxiv_ids IS NOT NULL)
SELECT publication_id, array_to_string(list_sort(a), ';') ids FROM t WHERE len(a) > 0""")
def arxiv_bare_ids(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "publications", "publication_id", "arxiv_ids").where(F.size("arxiv_ids") > 0)
    return p.select("publication_id", F.array_join(F.array_sort(F.array_distinct(F.transform("arxiv_ids", X.arxiv_bare))), ";").alias("ids"))


# matching


def _title(x: str) -> str:
    bare = f"regexp_replace({x}, '\\[.*?\\]', ' ', 'g')"
    return sql_collapse(f"regexp_replace(lower({sql_fold(bare)}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')")


@query(f"""WITH w AS (SELECT record_id, venue, year, {_title('title')} k FROM workshop WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY venue, year, {_title('title')} ORDER BY record_id DESC) = 1)
SELECT paper_id, record_id FROM papers_compact p JOIN w ON w.venue = p.venue AND w.year = p.year AND w.k = {_title('p.title')} WHERE k <> ''""")
def title_exact_match(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "venue", "year", "title").withColumn("k", N.title_folded(F.col("title"))).where("k <> ''")
    w = matching.last_of(w.withColumn("slot", F.concat_ws("|", "venue", "year", "k")), "slot", "record_id")
    p = table(spark, base, "papers_compact", "paper_id", "venue", "year", "title").withColumn("slot", F.concat_ws("|", "venue", "year", N.title_folded(F.col("title"))))
    return p.join(w.select("slot", "record_id"), "slot").select("paper_id", "record_id")


def _candidates(spark: SparkSession, base: str) -> DataFrame:
    left = table(spark, base, "papers_compact", "paper_id", "venue", "year", "title").withColumnRenamed("paper_id", "id")
    right = table(spark, base, "workshop", "record_id", "venue", "year", "title").withColumnRenamed("record_id", "id")
    return matching.title_candidates(left, right, ["venue", "year"])


def _tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in N.STOPWORDS)
    drop = f"NOT list_contains([{stop}], t) AND NOT regexp_full_match(t, '(qip|qcrypt|tqc)\\d{{0,4}}|\\d{{4}}|.')"
    return f"list_distinct(list_filter(regexp_extract_all({_importer(x)}, '[a-z0-9]+'), lambda t: {drop}))"


@query(f"""WITH a AS (SELECT paper_id left_id, venue, year, {_tokens('title')} a FROM papers_compact WHERE title IS NOT NULL), b AS (SELECT record_id right_id, venue, year, {_tokens('title')} b FROM workshop WHERE title IS NOT NULL),
p AS (SELECT left_id, right_id, a.venue, a.year, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) score FROM a JOIN b ON a.venue = b.venue AND a.year = b.year WHERE len(a) > 0 AND len(b) > 0)
SELECT left_id, right_id, venue, year::BIGINT AS year, round(score, 6) score FROM p WHERE score >= 0.45""")
def title_jaccard_candidates(spark: SparkSession, base: str) -> DataFrame:
    return _candidates(spark, base).withColumn("score", F.round("score", 6))


def _scored(spark: SparkSession, base: str) -> DataFrame:
    names = table(spark, base, "papers_compact", "paper_id", "authors").select(F.col("paper_id").alias("left_id"), X.list_items(F.col("authors")).alias("names"))
    texts = table(spark, base, "workshop", "record_id", "title", "authors").select(F.col("record_id").alias("right_id"), F.concat_ws(" ", "title", "authors").alias("text"))
    return matching.with_author_bonus(_candidates(spark, base), names, texts)


@query(None)
def greedy_assignment(spark: SparkSession, base: str) -> DataFrame:
    return matching.greedy_assignment(_scored(spark, base), ["venue", "year"])


@query(f"""WITH a AS (SELECT paper_id left_id, venue, year, {_tokens('title')} a, list_transform(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: string_split({_importer('x')}, ' ')[-1]) names FROM papers_compact WHERE title IS NOT NULL),
b AS (SELECT record_id right_id, venue, year, {_tokens('title')} b, regexp_extract_all({_importer("concat_ws(' ', title, authors)")}, '[a-z0-9]+') said FROM workshop WHERE title IS NOT NULL),
p AS (SELECT left_id, right_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) title_score, coalesce(len(list_filter(names, lambda x: x <> '' AND list_contains(said, x))), 0) overlap FROM a JOIN b ON a.venue = b.venue AND a.year = b.year WHERE len(a) > 0 AND len(b) > 0)
SELECT left_id, right_id, round(title_score, 6) title_score, overlap, round(title_score + 0.15 * least(overlap, 2), 6) score FROM p WHERE title_score >= 0.45""")
def title_scores_with_authors(spark: SparkSession, base: str) -> DataFrame:
    return _scored(spark, base).select("left_id", "right_id", F.round("title_score", 6).alias("title_score"), "overlap", F.round("score", 6).alias("score"))


@query(f"""WITH a AS (SELECT paper_id, venue, year, {_tokens('title')} a FROM papers_compact WHERE title IS NOT NULL), b AS (SELECT venue, year, {_tokens('title')} b FROM workshop WHERE title IS NOT NULL),
p AS (SELECT paper_id, max(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))) s FROM a JOIN b ON a.venue = b.venue AND a.year = b.year WHERE len(a) > 0 AND len(b) > 0 GROUP BY 1),
c AS (SELECT CASE WHEN s >= 0.62 THEN 'matched' WHEN s >= 0.45 THEN 'weak' ELSE 'unmatched' END category FROM papers_compact LEFT JOIN p USING (paper_id))
SELECT category, count(*) n, floor(100 * count(*) / (SELECT count(*) FROM c))::BIGINT percent FROM c GROUP BY 1""")
def match_report(spark: SparkSession, base: str) -> DataFrame:
    best = _candidates(spark, base).groupBy(F.col("left_id").alias("paper_id")).agg(F.max("score").alias("s"))
    kind = F.when(F.col("s") >= matching.CONFIDENT, "matched").when(F.col("s") >= matching.WEAK, "weak").otherwise("unmatched")
    counts = table(spark, base, "papers_compact", "paper_id").join(best, "paper_id", "left").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("all_"))
    return counts.join(every).select("category", "n", F.floor(100 * F.col("n") / F.col("all_")).alias("percent"))


def _words(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"list_distinct(list_filter(string_split({sql_collapse(bare)}, ' '), lambda t: t <> ''))"


@query(f"""WITH t AS (SELECT paper_id, venue, year, {_words('title')} a, trim(coalesce(arxiv_ids, '')) i FROM papers_compact), s AS (SELECT record_id, venue, year, {_words('title')} b, list_transform(string_split(arxiv_ids, ';'), lambda x: trim(x)) ids FROM workshop),
p AS (SELECT paper_id talk_id, record_id slot_id, CASE WHEN i <> '' AND list_contains(ids, i) THEN 100.0 ELSE 0.0 END + 50.0 * CASE WHEN len(coalesce(a, [])) = 0 OR len(coalesce(b, [])) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END score FROM t JOIN s ON t.venue = s.venue AND t.year = s.year)
SELECT talk_id, slot_id, round(score::DOUBLE, 6) score FROM p WHERE score > 20 QUALIFY row_number() OVER (PARTITION BY talk_id ORDER BY score DESC, slot_id) = 1""")
def schedule_best_match(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "papers_compact", "paper_id", "venue", "year", "title", "arxiv_ids").select(F.col("paper_id").alias("id"), "venue", "year", "title", F.trim(F.coalesce("arxiv_ids", F.lit(""))).alias("arxiv_id"))
    s = table(spark, base, "workshop", "record_id", "venue", "year", "title", "arxiv_ids").select(F.col("record_id").alias("id"), "venue", "year", "title", F.transform(F.split("arxiv_ids", ";"), lambda x: F.trim(x)).alias("arxiv_ids"))
    return matching.best_schedule_match(t, s, ["venue", "year"]).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT talk_id, {_importer(sql_fold('speaker'))} nc, {sql_items('authors')} l FROM talks WHERE speaker IS NOT NULL), u AS (SELECT talk_id, nc, unnest(l) AS name, generate_subscripts(l, 1) p FROM t),
k AS (SELECT *, {_importer(sql_fold('name'))} AS k FROM u), o AS (SELECT *, string_split(k, ' ') a, string_split(nc, ' ') b FROM k QUALIFY row_number() OVER (PARTITION BY talk_id, k ORDER BY p) = 1),
f AS (SELECT *, k = nc exact, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 OR len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 sub, k <> '' AND a[-1] = b[-1] fam FROM o),
g AS (SELECT talk_id, count(*) FILTER (WHERE exact) e, count(*) FILTER (WHERE sub) s, count(*) FILTER (WHERE fam) f, arg_min(name, p) FILTER (WHERE exact) en, arg_min(name, p) FILTER (WHERE sub) sn, arg_min(name, p) FILTER (WHERE fam) fn FROM f GROUP BY 1)
SELECT t.talk_id, CASE WHEN nc = '' THEN NULL WHEN e > 0 THEN en WHEN s = 1 THEN sn WHEN s > 1 THEN NULL WHEN f = 1 THEN fn END matched, CASE WHEN nc = '' THEN 'none' WHEN e > 0 THEN 'exact' WHEN s = 1 THEN 'family_only' WHEN s > 1 THEN 'ambiguous' WHEN f = 1 THEN 'family_only' WHEN f > 1 THEN 'ambiguous' ELSE 'none' END confidence FROM t LEFT JOIN g ON g.talk_id = t.talk_id""")
def speaker_resolution(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "talks", "talk_id", "speaker", "authors").where("speaker is not null")
    return t.select("talk_id", linkage.match_person(F.col("speaker"), F.coalesce(X.list_items(F.col("authors")), F.array().cast("array<string>"))).alias("m")).select("talk_id", "m.matched", "m.confidence")


@query(SILVER + f""", s AS (SELECT publication_id, {sql_items('speakers')} sp FROM s_rows), o AS (SELECT publication_id, {_importer('sp[1]')} k FROM s WHERE len(sp) = 1),
m AS (SELECT publication_id, author_id, {_importer('name')} k FROM s_mentions_ids)
SELECT r.publication_id, p.author_id presenter_author_id FROM s_rows r LEFT JOIN (SELECT o.publication_id, min(m.author_id) author_id FROM o JOIN m ON m.publication_id = o.publication_id AND m.k = o.k AND o.k <> '' GROUP BY 1 HAVING count(DISTINCT m.author_id) = 1) p ON p.publication_id = r.publication_id""".replace("FROM s_mentions_ids", "FROM (SELECT publication_id, name, md5(name_key) author_id FROM s_mentions WHERE name_key <> '')"))
def presenter_set(spark: SparkSession, base: str) -> DataFrame:
    rows = silver.rows(spark, base).select("publication_id", X.list_items(F.col("speakers")).alias("sp"))
    one = rows.where(F.size("sp") == 1).select("publication_id", N.importer_name(F.col("sp")[0]).alias("k")).where("k <> ''")
    listed = silver.mentions(spark, base).select("publication_id", "author_id", N.importer_name(F.col("name")).alias("k"))
    hit = one.join(listed, ["publication_id", "k"]).groupBy("publication_id").agg(F.min("author_id").alias("lo"), F.max("author_id").alias("hi")).where("lo = hi")
    return rows.select("publication_id").join(hit.select("publication_id", F.col("lo").alias("presenter_author_id")), "publication_id", "left")


# search


def _lexemes(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP)
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains([{stop}], w))"


_STATE = "['state', 'states', 'stated', 'stating']"  # the words of the stem


@query(f"""WITH d AS (SELECT record_id, title, list_concat({_lexemes('title')}, {_lexemes('abstract')}) w FROM workshop)
SELECT record_id, title FROM d WHERE list_has_any(w, ['graph', 'graphs', 'graphed', 'graphing']) AND list_has_any(w, {_STATE})""")
def fts_and_match(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "title", "abstract")
    doc = search.stemmed(w.select("record_id", "title", F.concat(search.lexemes(F.col("title")), search.lexemes(F.col("abstract"))).alias("words_")), "words_", "stems_")
    return doc.where(search.matches(F.col("stems_"), "the graph states")).select("record_id", "title")


@query(None)
def fts_ranked(spark: SparkSession, base: str) -> DataFrame:
    return search.ranked(table(spark, base, "workshop", "record_id", "title", "abstract"), "record_id", "title", "abstract", "efficient verification")


# more of the pages


@query("""WITH t AS (SELECT record_id, lower(trim(title)) x FROM workshop WHERE title IS NOT NULL)
SELECT record_id FROM t WHERE len(x) >= 10 AND NOT (""" + " OR ".join(f"contains(x, '{w}')" for w in X.NO_TALK) + ")")
def talk_items_only(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "title").where("title is not null")
    return w.where(X.is_talk(F.col("title"), X.NO_TALK, 10)).select("record_id")


@query("""WITH s AS (SELECT venue, year, coalesce(scheduled_date, '') AS day, coalesce(scheduled_time, '') AS clock, record_id FROM workshop)
SELECT venue, year::BIGINT AS year, day, clock, record_id, row_number() OVER (PARTITION BY venue, year, day, clock ORDER BY record_id) place FROM s QUALIFY count(*) OVER (PARTITION BY venue, year, day, clock) > 1""")
def merged_time_slots(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "venue", "year", "record_id", "scheduled_date", "scheduled_time")
    keys = ["venue", "year", "day", "clock"]
    w = w.select("venue", "year", F.coalesce("scheduled_date", F.lit("")).alias("day"), F.coalesce("scheduled_time", F.lit("")).alias("clock"), "record_id")
    several = w.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return numbered(w.join(several, keys, "left_semi"), keys, [F.col("record_id")], "place").select(*keys, "record_id", "place")


@query("""WITH c AS (SELECT venue, year, paper_type, count(*) n FROM workshop WHERE paper_type IS NOT NULL GROUP BY ALL) SELECT venue, year::BIGINT AS year, paper_type, n FROM c QUALIFY row_number() OVER (PARTITION BY venue, year ORDER BY n DESC, paper_type) = 1""")
def most_common_type(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "workshop", "venue", "year", "paper_type").where("paper_type is not null").groupBy("venue", "year", "paper_type").agg(F.count("*").alias("n"))
    return linkage.keep_first(c, [F.col("venue"), F.col("year")], [F.desc("n"), F.asc("paper_type")])


@query(SILVER + """, d AS (SELECT s.author_id, s.publication_id, p.venue, p.year, p.paper_type, p.title FROM s_authorships s JOIN s_pubs p ON p.publication_id = s.publication_id WHERE p.paper_type IS DISTINCT FROM 'poster' AND p.conference_id IS NOT NULL)
SELECT author_id, publication_id, year::BIGINT AS year, row_number() OVER (PARTITION BY author_id, year ORDER BY coalesce(list_position(['QIP','QCRYPT','TQC'], venue), 4), publication_id) - 1 stack,
CASE venue WHEN 'QIP' THEN 'fill-qip' WHEN 'QCRYPT' THEN 'fill-qcrypt' WHEN 'TQC' THEN 'fill-tqc' ELSE 'fill-ink' END fill, venue || ' ' || year || ' — ' || coalesce(paper_type, '') || ': ' || CASE WHEN len(title) > 80 THEN title[1:80] || '…' ELSE title END tooltip FROM d""")
def timeline_cells(spark: SparkSession, base: str) -> DataFrame:
    p = silver.publications(spark, base).where("conference_id is not null and (paper_type is null or paper_type <> 'poster')").select("publication_id", "venue", "year", "paper_type", "title")
    d = silver.authorships(spark, base).select("author_id", "publication_id").join(p, "publication_id")
    order = [F.coalesce(V.ordinal(F.col("venue"), statistics.VENUE_ORDER), F.lit(3)), F.col("publication_id")]
    fill = F.when(F.col("venue").isin(*statistics.VENUE_ORDER), F.concat(F.lit("fill-"), F.lower("venue"))).otherwise("fill-ink")
    tip = F.concat(F.col("venue"), F.lit(" "), F.col("year").cast("string"), F.lit(" — "), F.coalesce("paper_type", F.lit("")), F.lit(": "), N.truncate(F.col("title")))
    return numbered(d, ["author_id", "year"], order, "n_").select("author_id", "publication_id", "year", (F.col("n_") - 1).alias("stack"), fill.alias("fill"), tip.alias("tooltip"))


@query("SELECT authorship_id, publication_id, author_id, author_position::BIGINT author_position FROM authorships ORDER BY created_at DESC NULLS LAST, authorship_id LIMIT 100")
def authorship_list_capped(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "authorships", "authorship_id", "publication_id", "author_id", "author_position", "created_at")
    return s.orderBy(F.desc_nulls_last("created_at"), "authorship_id").limit(100).drop("created_at")


@query("""SELECT record_id, CASE WHEN regexp_matches(video_url, 'youtube\\.com|youtu\\.be|multimedia\\.ethz\\.ch') OR contains(lower(coalesce(title, '')), 'video') OR contains(lower(coalesce(title, '')), 'watch') THEN 'video' WHEN lower(video_url) LIKE '%.pdf' OR contains(lower(coalesce(title, '')), 'slides') THEN 'slides' END video_kind,
CASE WHEN lower(presentation_url) LIKE '%.pdf' THEN 'slides' END deck_kind FROM workshop WHERE video_url IS NOT NULL OR presentation_url IS NOT NULL""")
def link_kinds(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "workshop", "record_id", "title", "video_url", "presentation_url").where("video_url is not null or presentation_url is not null")
    return w.select("record_id", X.link_kind(F.col("video_url"), F.col("title")).alias("video_kind"), X.link_kind(F.col("presentation_url"), F.lit(None).cast("string")).alias("deck_kind"))


@query("SELECT member_id, CASE " + " ".join(f"WHEN contains(lower(concat_ws(' ', committee_type, role_title)), '{a}') THEN '{b}'" for a, b in X.ROLES) + """ END role, CASE WHEN regexp_matches(lower(concat_ws(' ', committee_type, role_title)), 'co[- ]chair') THEN 'co-chair' WHEN contains(lower(concat_ws(' ', committee_type, role_title)), 'chair') THEN 'chair' ELSE 'member' END said FROM committees""")
def role_titles(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "committees", "member_id", "committee_type", "role_title")
    return c.select("member_id", X.role_title(F.col("role_title"), F.col("committee_type")).alias("role"), X.position_in_words(F.concat_ws(" ", "committee_type", "role_title")).alias("said"))


@query("""SELECT authorship_id, json_object('source_type', coalesce(json_extract_string(metadata, '$.source_type'), 'unknown'), 'file', 'authorships')::VARCHAR metadata FROM authorships""")
def metadata_merge(spark: SparkSession, base: str) -> DataFrame:
    kind = F.coalesce(F.get_json_object("metadata", "$.source_type"), F.lit("unknown"))
    return table(spark, base, "authorships", "authorship_id", "metadata").select("authorship_id", F.to_json(F.struct(kind.alias("source_type"), F.lit("authorships").alias("file"))).alias("metadata"))


@query("""WITH n AS (SELECT publication_id, author_id, min(author_position) author_position FROM authorships WHERE author_position <= 2 AND publication_id IS NOT NULL AND author_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT publication_id, author_id, author_position FROM authorships WHERE publication_id IS NOT NULL AND publication_id NOT IN (SELECT publication_id FROM n))
SELECT publication_id, author_id, author_position::BIGINT author_position FROM (SELECT * FROM k UNION ALL SELECT * FROM n)""")
def replace_children(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "authorships", "publication_id", "author_id", "author_position").where("publication_id is not null")
    new = s.where("author_position <= 2 and author_id is not null").groupBy("publication_id", "author_id").agg(F.min("author_position").alias("author_position"))
    return mutate.replace_children(s, new, "publication_id")


# constraints and changes


@query("""SELECT 'authorships' table_name, publication_id || '|' || author_id AS dup_key, count(*) n FROM authorships WHERE publication_id IS NOT NULL AND author_id IS NOT NULL GROUP BY publication_id, author_id HAVING count(*) > 1
UNION ALL SELECT 'positions', publication_id || '|' || author_position, count(*) FROM authorships WHERE publication_id IS NOT NULL AND author_position IS NOT NULL GROUP BY publication_id, author_position HAVING count(*) > 1
UNION ALL SELECT 'conferences', venue || '|' || year, count(*) FROM conferences GROUP BY venue, year HAVING count(*) > 1""")
def unique_key_violations(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authorships", "publication_id", "author_id", "author_position")
    parts = [("authorships", V.duplicate_keys(a, "publication_id", "author_id"), ("publication_id", "author_id")), ("positions", V.duplicate_keys(a, "publication_id", "author_position"), ("publication_id", "author_position")), ("conferences", V.duplicate_keys(table(spark, base, "conferences", "venue", "year"), "venue", "year"), ("venue", "year"))]
    return statistics.union_all([d.select(F.lit(n).alias("table_name"), F.concat_ws("|", *k).alias("dup_key"), "n") for n, d, k in parts])


@query("""SELECT 'authorships.author' fk, count(*) n FROM authorships s WHERE author_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM authors a WHERE a.author_id = s.author_id)
UNION ALL SELECT 'authorships.publication', count(*) FROM authorships s WHERE publication_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM publications p WHERE p.publication_id = s.publication_id)
UNION ALL SELECT 'publications.conference', count(*) FROM publications p WHERE conference_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conferences c WHERE c.conference_id = p.conference_id)""")
def foreign_key_orphans(spark: SparkSession, base: str) -> DataFrame:
    s, p = table(spark, base, "authorships", "publication_id", "author_id"), table(spark, base, "publications", "publication_id", "conference_id")
    parts = (("authorships.author", V.orphans(s, "author_id", table(spark, base, "authors", "author_id"), "author_id")), ("authorships.publication", V.orphans(s, "publication_id", p, "publication_id")), ("publications.conference", V.orphans(p, "conference_id", table(spark, base, "conferences", "conference_id"), "conference_id")))
    return statistics.union_all([d.agg(F.count("*").alias("n")).select(F.lit(n).alias("fk"), "n") for n, d in parts])


@query("""SELECT author_id, concat_ws(',', CASE WHEN NOT (octet_length(encode(full_name)) <= 255) THEN 'name' END, CASE WHEN homepage_url <> '' AND NOT regexp_matches(homepage_url, '(?i)^\\s*https?://\\s*\\S') THEN 'url' END) reason FROM authors WHERE reason <> ''
UNION ALL SELECT conference_id, 'country' FROM conferences WHERE NOT regexp_full_match(country_code, '[A-Z]{2}')""")
def constraint_report(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "full_name", "homepage_url")
    _, bad = mutate.quarantine(a, {"name": V.text_fits(F.col("full_name"), "name"), "url": V.url_ok(F.col("homepage_url"))})
    _, worse = mutate.quarantine(table(spark, base, "conferences", "conference_id", "country_code"), {"country": V.country_ok(F.col("country_code"))})
    return bad.select("author_id", "reason").union(worse.select("conference_id", "reason"))


@query("""WITH n AS (SELECT venue, year, 'https://new.example.org/' || lower(venue) || year AS url FROM conferences WHERE is_virtual UNION ALL SELECT 'QIP', 2040, 'https://new.example.org/qip2040')
SELECT coalesce(c.venue, n.venue) venue, coalesce(c.year, n.year)::BIGINT AS year, coalesce(n.url, c.website_url) website_url, c.city FROM conferences c FULL JOIN n ON n.venue = c.venue AND n.year = c.year""")
def upsert_selective(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "conferences", "venue", "year", "website_url", "city", "is_virtual")
    url = F.concat(F.lit("https://new.example.org/"), F.lower("venue"), F.col("year").cast("string"))
    new = c.where("is_virtual").select("venue", "year", url.alias("website_url")).union(spark.range(1).select(F.lit("QIP"), F.lit(2040), F.lit("https://new.example.org/qip2040")))
    return mutate.upsert(c.drop("is_virtual"), new, ["venue", "year"], "website_url").select("venue", "year", "website_url", "city")


@query("""WITH n AS (SELECT author_id, nullif(max(affiliation), '') affiliation FROM authorships WHERE author_id IS NOT NULL GROUP BY 1)
SELECT a.author_id, coalesce(n.affiliation, a.affiliation) affiliation, a.homepage_url FROM authors a LEFT JOIN n ON n.author_id = a.author_id""")
def partial_update_coalesce(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "affiliation", "homepage_url")
    new = table(spark, base, "authorships", "author_id", "affiliation").where("author_id is not null").groupBy("author_id").agg(F.nullif(F.max("affiliation"), F.lit("")).alias("affiliation"))
    return mutate.patch(a, new, "author_id", "affiliation")


@query("""SELECT 'publications' table_name, count(*) n FROM publications WHERE paper_type IS DISTINCT FROM 'poster'
UNION ALL SELECT 'authorships', count(*) FROM authorships s WHERE NOT EXISTS (SELECT 1 FROM publications p WHERE p.publication_id = s.publication_id AND p.paper_type = 'poster')""")
def delete_cascade(spark: SparkSession, base: str) -> DataFrame:
    p, s = table(spark, base, "publications", "publication_id", "paper_type"), table(spark, base, "authorships", "authorship_id", "publication_id")
    left, kept = mutate.delete_cascade(p, s, p.where("paper_type = 'poster'"))
    return left.agg(F.count("*").alias("n")).select(F.lit("publications").alias("table_name"), "n").union(kept.agg(F.count("*").alias("n")).select(F.lit("authorships"), "n"))


@query("""SELECT author_id, full_name FROM authors UNION ALL SELECT md5(k), n FROM (SELECT lower(trim(full_name)) k, min(full_name) n FROM committees WHERE full_name IS NOT NULL GROUP BY 1) WHERE md5(k) NOT IN (SELECT author_id FROM authors)""")
def insert_do_nothing(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "authors", "author_id", "full_name")
    new = table(spark, base, "committees", "full_name").where("full_name is not null").groupBy(F.lower(F.trim("full_name")).alias("k")).agg(F.min("full_name").alias("full_name")).select(F.md5("k").alias("author_id"), "full_name")
    return mutate.insert_new(a, new, ["author_id"])


@query("""SELECT paper_id, coalesce(paper_type, 'regular') paper_type, coalesce(title, '') title, coalesce(speaker, '') speaker, false is_proceedings_track, '{}' metadata FROM papers_compact""")
def insert_with_defaults(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "papers_compact", "paper_id", "paper_type", "title", "speaker")
    return mutate.with_defaults(p, {"paper_type": "regular", "title": "", "speaker": "", "is_proceedings_track": False, "metadata": "{}"})


def _all() -> None:
    """Register the queries of the other modules as well."""
    from biblioweave.plans import imports, pages, texts  # noqa: F401


def queries() -> dict[str, registry.Query]:
    _all()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(registry.SQL)
