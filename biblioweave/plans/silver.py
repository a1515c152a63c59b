"""Authors, publications, authorships and committee roles made from the delivered talks, workshop and committees tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.sources.tables import table


def rows(spark: SparkSession, base: str) -> DataFrame:
    """Talks of both layouts in one: (publication_id, venue, year, paper_type, title, speakers, authors, affiliations, award, ...)."""
    t = table(spark, base, "talks").select(
        F.concat(F.lit("talks:"), F.col("talk_id").cast("string")).alias("publication_id"), F.col("talk_id").alias("rid"), F.lit("talks").alias("src"), "venue", "year", "paper_type", "title", F.col("speaker").alias("speakers"), "authors",
        F.lit(None).cast("string").alias("affiliations"), F.lit(None).cast("string").alias("award"), "abstract", F.lit(None).cast("string").alias("session_name"), "scheduled_date", "scheduled_time", F.col("duration").alias("duration_minutes"), "loaded_at",
    )
    w = table(spark, base, "workshop").select(
        F.concat(F.lit("workshop:"), F.col("record_id").cast("string")).alias("publication_id"), F.col("record_id").alias("rid"), F.lit("workshop").alias("src"), "venue", "year", "paper_type", "title", "speakers", "authors",
        "affiliations", "award", "abstract", "session_name", "scheduled_date", "scheduled_time", "duration_minutes", "loaded_at",
    )
    return t.unionByName(w)


def publications(spark: SparkSession, base: str) -> DataFrame:
    conf = table(spark, base, "conferences", "conference_id", "venue", "year").withColumnRenamed("venue", "cv").withColumnRenamed("year", "cy")
    r = rows(spark, base)
    return r.join(conf, (r["venue"] == conf["cv"]) & (r["year"] == conf["cy"]), "left").drop("cv", "cy")


def mentions(spark: SparkSession, base: str) -> DataFrame:
    """(publication_id, name, author_position, affiliation, author_id): every listed author, affiliations by place as imported."""
    r = rows(spark, base).select("publication_id", F.posexplode(X.list_items(F.col("authors"))).alias("p", "name"), X.list_items(F.col("affiliations")).alias("aff"))
    keyed = r.select("publication_id", "name", (F.col("p") + 1).alias("author_position"), F.get("aff", F.col("p")).alias("affiliation"), N.normalize_name(F.col("name")).alias("name_key"))
    return keyed.where("name_key <> ''").withColumn("author_id", F.md5("name_key"))


def authorships(spark: SparkSession, base: str) -> DataFrame:
    """One row a (publication, author), that of the first place."""
    m = mentions(spark, base)
    one = m.groupBy("publication_id", "author_id").agg(F.min_by(F.struct("name", "author_position", "affiliation"), "author_position").alias("s"))
    return one.select("publication_id", "author_id", "s.name", "s.author_position", "s.affiliation")


def roles(spark: SparkSession, base: str) -> DataFrame:
    """Committee members with codes of committee and position as imported."""
    conf = table(spark, base, "conferences", "conference_id", "venue", "year")
    c = table(spark, base, "committees").join(conf, ["venue", "year"], "left").withColumn("name_key", N.normalize_name(F.col("full_name"))).where("name_key <> ''")
    return c.select(F.col("member_id").cast("string").alias("role_id"), F.md5("name_key").alias("author_id"), "conference_id", "venue", "year", X.committee_code(F.col("committee_type")).alias("committee"), X.position_code(F.col("position")).alias("position"), "affiliation", "role_title", "full_name")


def authors(spark: SparkSession, base: str) -> DataFrame:
    """One author a normalized name among authors and members, shown by the smallest spelling."""
    both = mentions(spark, base).select("author_id", "name").union(roles(spark, base).select("author_id", F.col("full_name").alias("name")))
    return both.groupBy("author_id").agg(F.min("name").alias("full_name")).withColumn("affiliation", F.lit(None).cast("string"))


# the same in SQL

_WS = "[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_FROM, _TO = "".join(N.SPECIAL), "".join(N.SPECIAL.values())


def sql_fold(x: str) -> str:
    return f"regexp_replace(strip_accents(translate({x}, '{_FROM}', '{_TO}')), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def sql_norm(x: str) -> str:
    return sql_collapse(f"lower({sql_fold(x)})")


def sql_items(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ';'), lambda x: trim(x)), lambda x: x <> '')"


SQL = f"""
WITH s_rows AS (
SELECT 'talks:' || talk_id publication_id, talk_id rid, 'talks' src, venue, year, paper_type, title, speaker speakers, authors, NULL::VARCHAR affiliations, NULL::VARCHAR award, abstract, NULL::VARCHAR session_name, scheduled_date, scheduled_time, duration duration_minutes FROM talks
UNION ALL SELECT 'workshop:' || record_id, record_id, 'workshop', venue, year, paper_type, title, speakers, authors, affiliations, award, abstract, session_name, scheduled_date, scheduled_time, duration_minutes FROM workshop),
s_pubs AS (SELECT r.*, c.conference_id FROM s_rows r LEFT JOIN conferences c ON c.venue = r.venue AND c.year = r.year),
s_lists AS (SELECT publication_id, {sql_items('authors')} a, {sql_items('affiliations')} f FROM s_rows WHERE trim(authors) <> ''),
s_flat AS (SELECT publication_id, unnest(a) name, generate_subscripts(a, 1) author_position, f FROM s_lists),
s_mentions AS (SELECT publication_id, name, author_position, f[author_position] affiliation, {sql_norm('name')} name_key FROM s_flat),
s_authorships AS (SELECT publication_id, md5(name_key) author_id, name, author_position, affiliation FROM s_mentions WHERE name_key <> ''
  QUALIFY row_number() OVER (PARTITION BY publication_id, md5(name_key) ORDER BY author_position) = 1),
s_named AS (SELECT m.*, c.conference_id, {sql_norm('full_name')} name_key FROM committees m LEFT JOIN conferences c ON c.venue = m.venue AND c.year = m.year),
s_roles AS (SELECT member_id::VARCHAR role_id, md5(name_key) author_id, conference_id, venue, year,
  CASE committee_type WHEN 'program' THEN 'PC' WHEN 'steering' THEN 'SC' WHEN 'local_organizing' THEN 'Local' WHEN 'organizing' THEN 'OC' ELSE committee_type END committee,
  CASE lower(trim(position)) WHEN 'chair' THEN 'chair' WHEN 'co-chair' THEN 'co_chair' WHEN 'area_chair' THEN 'area_chair' ELSE 'member' END AS position,
  affiliation, role_title, full_name FROM s_named WHERE name_key <> ''),
s_authors AS (SELECT author_id, min(name) full_name FROM (SELECT md5(name_key) author_id, name FROM s_mentions WHERE name_key <> '' UNION ALL SELECT author_id, full_name FROM s_roles) GROUP BY author_id),
s_seen AS (SELECT a.author_id, a.publication_id, NULL role_id, NULL AS position, p.conference_id, a.affiliation FROM s_authorships a JOIN s_pubs p ON p.publication_id = a.publication_id
  UNION ALL SELECT author_id, NULL, role_id, position, conference_id, affiliation FROM s_roles)
"""
