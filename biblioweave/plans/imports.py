"""Imports by key, rejected rows, merges of duplicates and the outcomes of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.functions import validate as V
from biblioweave.operators import linkage, matching, mutate
from biblioweave.plans import silver
from biblioweave.plans.reference import _candidates, _importer, _tokens
from biblioweave.plans.registry import query
from biblioweave.plans.silver import SQL as SILVER
from biblioweave.plans.silver import sql_collapse, sql_fold, sql_items, sql_norm
from biblioweave.sources.tables import table

# imports by key


@query(SILVER + """, k AS (SELECT src, rid, title, paper_type, venue || year || '-' || paper_type || '-' || row_number() OVER (PARTITION BY src, venue, year, paper_type ORDER BY rid) canonical_key FROM s_rows),
o AS (SELECT * FROM k WHERE src = 'talks' AND canonical_key IS NOT NULL), n AS (SELECT * FROM k WHERE src = 'workshop' AND canonical_key IS NOT NULL)
SELECT coalesce(n.canonical_key, o.canonical_key) canonical_key, CASE WHEN n.rid IS NULL THEN o.title ELSE n.title END title, coalesce(n.rid, o.rid) rid FROM o FULL JOIN n ON n.canonical_key = o.canonical_key""")
def keyed_import(spark: SparkSession, base: str) -> DataFrame:
    """Talks, then the workshop imported over them: keys count per file, so that some collide and the later row stays."""
    keyed = linkage.canonical_keys(silver.rows(spark, base), "rid", F.col("src")).where("canonical_key is not null").select("canonical_key", "src", "rid", "title")
    old, new = keyed.where("src = 'talks'").drop("src"), keyed.where("src = 'workshop'").drop("src")
    return mutate.overwrite(old, new, ["canonical_key"], "rid", "title", "rid").select("canonical_key", "title", "rid")


@query(SILVER + """SELECT conference_id, author_id, committee, position, affiliation, role_id FROM s_roles WHERE conference_id IS NOT NULL AND committee IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY conference_id, author_id, committee ORDER BY role_id::BIGINT DESC) = 1""")
def roles_import(spark: SparkSession, base: str) -> DataFrame:
    """Committee roles by conference, author and committee, position left aside: the last delivered row stays."""
    r = silver.roles(spark, base).where("conference_id is not null and committee is not null").select("conference_id", "author_id", "committee", "position", "affiliation", "role_id", F.col("role_id").cast("long").alias("order_"))
    empty = r.drop("order_").limit(0)
    return mutate.overwrite(empty, r, ["conference_id", "author_id", "committee"], "order_", "position", "affiliation", "role_id")


@query(SILVER + f"""SELECT publication_id, 'authors' reason FROM s_rows WHERE coalesce(len({sql_items('authors')}), 0) = 0 AND coalesce(len({sql_items('speakers')}), 0) = 0""")
def import_rejected(spark: SparkSession, base: str) -> DataFrame:
    """Talks with neither authors nor speakers are kept apart with the reason."""
    r = silver.rows(spark, base).select("publication_id", F.coalesce(X.list_items(F.col("authors")), F.array().cast("array<string>")).alias("a"), F.coalesce(X.list_items(F.col("speakers")), F.array().cast("array<string>")).alias("s"))
    _, bad = mutate.quarantine(r, {"authors": (F.size("a") > 0) | (F.size("s") > 0)})
    return bad.select("publication_id", "reason")


@query(SILVER + f"""SELECT publication_id, array_to_string(CASE WHEN coalesce(len({sql_items('authors')}), 0) > 0 THEN {sql_items('authors')} ELSE {sql_items('speakers')} END, ';') people FROM s_rows WHERE coalesce(len({sql_items('authors')}), 0) > 0 OR coalesce(len({sql_items('speakers')}), 0) > 0""")
def import_people(spark: SparkSession, base: str) -> DataFrame:
    """Authors of each talk as imported: where there are none the speakers."""
    a = F.coalesce(F.filter(X.list_items(F.col("authors")), lambda x: x != ""), F.array().cast("array<string>"))
    people = F.when(F.size(a) > 0, a).otherwise(F.coalesce(X.list_items(F.col("speakers")), F.array().cast("array<string>")))
    return silver.rows(spark, base).select("publication_id", people.alias("p")).where(F.size("p") > 0).select("publication_id", F.array_join("p", ";").alias("people"))


@query("""WITH w AS (SELECT record_id, concat_ws(',', CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN trim(coalesce(duration_minutes, '')) <> '' AND NOT regexp_full_match(trim(duration_minutes), '\\d+') THEN 'duration' END,
CASE WHEN trim(coalesce(scheduled_date, '')) <> '' AND NOT regexp_full_match(trim(scheduled_date), '\\d{4}-\\d{2}-\\d{2}') THEN 'date' END, CASE WHEN coalesce(video_url, '') <> '' AND NOT regexp_matches(video_url, '(?i)^\\s*https?://\\s*\\S') THEN 'url' END) reason FROM workshop) SELECT * FROM w WHERE reason <> ''""")
def workshop_quarantine(spark: SparkSession, base: str) -> DataFrame:
    """Delivered rows that the importer's checks don't pass, each with all the reasons."""
    w = table(spark, base, "workshop", "record_id", "title", "duration_minutes", "scheduled_date", "video_url")
    shaped = lambda c, p: (F.coalesce(F.trim(c), F.lit("")) == "") | F.trim(c).rlike(p)
    checks = {"title": F.trim("title") != "", "duration": shaped("duration_minutes", "^\\d+$"), "date": shaped("scheduled_date", "^\\d{4}-\\d{2}-\\d{2}$"), "url": V.url_ok(F.col("video_url"))}
    return mutate.quarantine(w, checks)[1].select("record_id", "reason")


@query(f"""WITH m AS (SELECT member_id, full_name, {sql_norm('full_name')} k FROM committees), o AS (SELECT k name_key, arg_min(full_name, member_id) first_name FROM m WHERE k <> '' GROUP BY k),
a AS (SELECT {sql_norm('full_name')} k, author_id id, 0 r FROM authors UNION ALL SELECT lower(full_name || ' (qi)'), author_id, 1 FROM authors UNION ALL SELECT {sql_norm('full_name')}, 'v' || min(member_id), 1 FROM committees WHERE length(full_name) > 18 GROUP BY 1),
b AS (SELECT k, arg_min(id, (r, id)) id FROM a GROUP BY 1) SELECT name_key, coalesce(id, md5(name_key)) author_id, id IS NULL is_new, first_name FROM o LEFT JOIN b ON b.k = name_key""")
def get_or_create_variants(spark: SparkSession, base: str) -> DataFrame:
    """Members found by an author's name, else by a kept variant of one, else created."""
    c = table(spark, base, "committees", "member_id", "full_name")
    a = table(spark, base, "authors", "author_id", "full_name")
    # kept variants: each author's name with a remark, and longer members' names of an author of their own
    kept = c.where(F.length("full_name") > 18).groupBy(N.normalize_name(F.col("full_name")).alias("variant")).agg(F.concat(F.lit("v"), F.min("member_id").cast("string")).alias("author_id"))
    variants = kept.select("author_id", "variant").union(a.select("author_id", F.lower(F.concat("full_name", F.lit(" (qi)")))))
    mentions = c.select(F.col("full_name").alias("name"), F.lit(None).cast("string").alias("affiliation"), F.col("member_id").alias("load_order"))
    return linkage.get_or_create(mentions, a, variants).select("name_key", "author_id", "is_new", "first_name")


# merges

_PLAN = f""", k AS (SELECT author_id, full_name, {_importer('full_name')} name_key, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w FROM s_authors),
r AS (SELECT *, len(w) b, list_bool_or(list_transform(w, lambda x: regexp_full_match(x, '.\\.')))::INT c, regexp_matches(full_name, '[^\\x00-\\x7f]')::INT d FROM k WHERE name_key <> ''),
t AS (SELECT *, first_value(author_id) OVER (PARTITION BY name_key ORDER BY b DESC, c DESC, d DESC, author_id) canonical_id FROM r), plan AS (SELECT author_id, canonical_id, name_key, full_name FROM t WHERE author_id <> canonical_id)
"""


@query(SILVER + _PLAN + """, m AS (SELECT r.role_id, r.conference_id, coalesce(p.canonical_id, r.author_id) author_id, r.committee, r.position, p.canonical_id IS NOT NULL moved FROM s_roles r LEFT JOIN plan p ON p.author_id = r.author_id)
SELECT role_id, conference_id, author_id, committee, position FROM m QUALIFY row_number() OVER (PARTITION BY conference_id, author_id, committee, position ORDER BY moved, role_id) = 1""")
def merge_roles(spark: SparkSession, base: str) -> DataFrame:
    r = silver.roles(spark, base).select("role_id", "conference_id", "author_id", "committee", "position")
    return linkage.merge_roles(r, linkage.merge_plan(silver.authors(spark, base)))


@query(SILVER + _PLAN + f""", v AS (SELECT md5(name_key) author_id, {_importer(sql_fold('name'))} normalized_variant, min(name) variant_name FROM s_mentions WHERE name_key <> '' GROUP BY 1, 2),
m AS (SELECT coalesce(p.canonical_id, v.author_id) author_id, variant_name, normalized_variant, 'spelling' variant_type, CASE WHEN p.canonical_id IS NULL THEN 0 ELSE 1 END o FROM v LEFT JOIN plan p ON p.author_id = v.author_id
UNION ALL SELECT canonical_id, full_name, name_key, 'alternate_spelling', 2 FROM plan)
SELECT author_id, variant_name, normalized_variant, variant_type FROM m QUALIFY row_number() OVER (PARTITION BY author_id, normalized_variant ORDER BY o, variant_name) = 1""")
def merge_variants(spark: SparkSession, base: str) -> DataFrame:
    """Spellings of authors after their merge."""
    v = silver.mentions(spark, base).groupBy("author_id", N.importer_name(F.col("name")).alias("normalized_variant")).agg(F.min("name").alias("variant_name")).withColumn("variant_type", F.lit("spelling"))
    authors = silver.authors(spark, base)
    return linkage.merge_variants(v, linkage.merge_plan(authors), authors)


@query(SILVER + _PLAN + "SELECT author_id, full_name FROM s_authors WHERE author_id NOT IN (SELECT author_id FROM plan)")
def merge_authors(spark: SparkSession, base: str) -> DataFrame:
    authors = silver.authors(spark, base)
    return linkage.merge_authors(authors, linkage.merge_plan(authors)).select("author_id", "full_name")


@query(f"""WITH k AS (SELECT author_id, full_name, {_importer("split_part(full_name, ' ', 1)")} name_key, list_filter(string_split({sql_collapse('full_name')}, ' '), lambda x: x <> '') w, coalesce(trim(homepage_url) <> '', false)::INT a FROM authors),
r AS (SELECT *, len(w) b, list_bool_or(list_transform(w, lambda x: regexp_full_match(x, '.\\.')))::INT c, regexp_matches(full_name, '[^\\x00-\\x7f]')::INT d FROM (SELECT author_id, full_name, {_importer('full_name')} name_key, w, a FROM k) WHERE name_key <> ''),
t AS (SELECT *, first_value(author_id) OVER (PARTITION BY name_key ORDER BY a DESC, b DESC, c DESC, d DESC, author_id) canonical_id FROM r) SELECT author_id, canonical_id FROM t WHERE author_id <> canonical_id""")
def merge_plan_identified(spark: SparkSession, base: str) -> DataFrame:
    """The plan where some authors have an identifier, which counts before all else; a home page stands in for it here."""
    a = table(spark, base, "authors", "author_id", "full_name", "homepage_url").withColumnRenamed("homepage_url", "orcid")
    return linkage.merge_plan(a).select("author_id", "canonical_id")


# changes


@query("""WITH b AS (SELECT authorship_id, publication_id, author_id, author_position, NOT coalesce(author_position >= 1, false) OR (author_id IS NOT NULL AND author_id NOT IN (SELECT author_id FROM authors)) OR (publication_id IS NOT NULL AND publication_id NOT IN (SELECT publication_id FROM publications)) bad FROM authorships),
t AS (SELECT *, row_number() OVER (PARTITION BY bad, publication_id, author_id ORDER BY authorship_id) a, row_number() OVER (PARTITION BY bad, publication_id, author_position ORDER BY authorship_id) p FROM b),
o AS (SELECT CASE WHEN bad THEN 'invalid' WHEN publication_id IS NOT NULL AND (author_id IS NOT NULL AND a > 1 OR author_position IS NOT NULL AND p > 1) THEN 'conflict' ELSE 'created' END outcome FROM t)
SELECT outcome, CASE outcome WHEN 'invalid' THEN 400 WHEN 'conflict' THEN 409 ELSE 201 END::BIGINT code, count(*) n FROM o GROUP BY 1""")
def insert_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """What inserting the delivered authorships comes to: two unique keys, two parents, a place of at least one."""
    s = table(spark, base, "authorships", "authorship_id", "publication_id", "author_id", "author_position")
    parents = {"author_id": (table(spark, base, "authors", "author_id"), "author_id"), "publication_id": (table(spark, base, "publications", "publication_id"), "publication_id")}
    out = mutate.insert_outcomes(s.limit(0), s, "authorship_id", [["publication_id", "author_id"], ["publication_id", "author_position"]], parents, {"place": F.col("author_position") >= 1})
    return out.groupBy("outcome", "code").agg(F.count("*").alias("n"))


@query(f"""WITH n AS (SELECT author_id, CASE WHEN affiliation IS NULL THEN full_name || ' Nováčková' END new_name FROM authors)
SELECT a.author_id, coalesce(new_name, full_name) full_name, {sql_norm('coalesce(new_name, full_name)')} normalized_name FROM authors a JOIN n ON n.author_id = a.author_id""")
def renamed_authors(spark: SparkSession, base: str) -> DataFrame:
    """A changed name changes its normalized form with it."""
    a = table(spark, base, "authors", "author_id", "full_name", "normalized_name", "affiliation")
    changes = a.where("affiliation is null").select("author_id", F.concat(F.col("full_name"), F.lit(" Nováčková")).alias("full_name"))
    return mutate.renamed(a.drop("affiliation"), changes).select("author_id", "full_name", "normalized_name")


@query("""SELECT authorship_id, CASE WHEN author_id IS NULL THEN '{"source_type":"none"}' ELSE metadata END metadata FROM authorships""")
def upsert_metadata(spark: SparkSession, base: str) -> DataFrame:
    """On a known key only the metadata are taken over."""
    s = table(spark, base, "authorships", "authorship_id", "author_id", "metadata")
    new = s.where("author_id is null").select("authorship_id", F.lit('{"source_type":"none"}').alias("metadata"))
    return mutate.upsert(s.drop("author_id"), new, ["authorship_id"], "metadata").select("authorship_id", "metadata")


# the review of a matching


@query(f"""WITH a AS (SELECT paper_id left_id, venue, year, {_tokens('title')} a FROM papers_compact WHERE title IS NOT NULL), b AS (SELECT record_id right_id, venue, year, {_tokens('title')} b FROM workshop WHERE title IS NOT NULL),
p AS (SELECT left_id, right_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) s FROM a JOIN b ON a.venue = b.venue AND a.year = b.year WHERE len(a) > 0 AND len(b) > 0),
o AS (SELECT left_id, right_id, s FROM p WHERE s >= 0.45 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id DESC) = 1)
SELECT paper_id, CASE WHEN s >= 0.62 THEN 'matched' WHEN s >= 0.45 THEN 'weak' ELSE 'unmatched' END category, right_id record_id, round(s, 6) score FROM papers_compact LEFT JOIN o ON left_id = paper_id""")
def match_review(spark: SparkSession, base: str) -> DataFrame:
    """Every listed paper with its best record of the schedule and how sure that is; without one it is unmatched."""
    best = linkage.keep_first(_candidates(spark, base), [F.col("left_id")], [F.desc("score"), F.desc("right_id")])
    kind = F.when(F.col("score") >= matching.CONFIDENT, "matched").when(F.col("score") >= matching.WEAK, "weak").otherwise("unmatched")
    papers = table(spark, base, "papers_compact", "paper_id").join(best.select(F.col("left_id").alias("paper_id"), F.col("right_id").alias("record_id"), "score"), "paper_id", "left")
    return papers.select("paper_id", kind.alias("category"), "record_id", F.round("score", 6).alias("score"))
