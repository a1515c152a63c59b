"""Derived tables: coauthor pairs, author and conference statistics, timelines, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Members of a publication in one tile; the pairs of longer author lists are made tile by tile, in different tasks.
TILE = 128


def coauthor_pairs(authorships: DataFrame) -> DataFrame:
    """(author1_id, author2_id, joint): every unordered pair of authors with the number of publications they share.

    An author counts once in a publication; null ids are left out. The smaller id comes first. Authors of a publication
    fall into tiles by a hash, one tile where they are few, and pairs are made of two tiles at a time, so that a very long
    author list is the work of many tasks; counts combine before the second shuffle.
    """
    m = authorships.where("publication_id is not null and author_id is not null").select("publication_id", "author_id").distinct()
    sized = m.groupBy("publication_id").agg(F.count("*").alias("k_")).where(F.col("k_") > TILE)
    tiles = F.ceil(F.col("k_") / TILE).cast("int")
    tiled = m.join(sized, "publication_id", "left").withColumns({"n_": F.coalesce(tiles, F.lit(1)), "t_": F.coalesce(F.pmod(F.xxhash64("author_id"), tiles), F.lit(0)).cast("int")})
    # each author goes to every pair of tiles that has its own: (least, most) of its tile and any tile
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_") - 1), lambda o: F.struct(F.least("t_", o).alias("a"), F.greatest("t_", o).alias("b"))))
    side = tiled.select("publication_id", "author_id", "t_", pair.alias("p")).select("publication_id", "p.a", "p.b", "t_", "author_id")
    left, right = side.where("t_ = a").toDF("publication_id", "a", "b", "t_", "x_"), side.where("t_ = b").toDF("publication_id", "a", "b", "u_", "y_")
    met = left.join(right, ["publication_id", "a", "b"]).where("a < b or x_ < y_")
    return met.groupBy(F.least("x_", "y_").alias("author1_id"), F.greatest("x_", "y_").alias("author2_id")).agg(F.count("*").alias("joint"))


def edges(pairs: DataFrame) -> DataFrame:
    """(author_id, partner_id, joint): each pair from both ends, so that a lookup needs no OR."""
    a, b = F.col("author1_id"), F.col("author2_id")
    return pairs.select(a.alias("author_id"), b.alias("partner_id"), "joint").union(pairs.select(b, a, "joint"))


def top_collaborators(authorships: DataFrame, authors: DataFrame, k: int = 20) -> DataFrame:
    """(author_id, rank, partner_id, partner_name, joint): the ``k`` most frequent coauthors of every author.

    Ties go by name, then id; partners without an author row are left out.
    """
    named = edges(coauthor_pairs(authorships)).join(authors.select(F.col("author_id").alias("partner_id"), F.col("full_name").alias("partner_name")), "partner_id")
    w = Window.partitionBy("author_id").orderBy(F.desc("joint"), F.asc_nulls_last("partner_name"), "partner_id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("author_id", "rank", "partner_id", "partner_name", "joint")


def appearances(authorships: DataFrame, publications: DataFrame, roles: DataFrame) -> DataFrame:
    """(author_id, publication_id, role_id, position, conference_id, affiliation): papers and committee service in one list.

    The union takes the place of a join with OR, which has no hash join and multiplies papers by roles.
    """
    none = lambda t="string": F.lit(None).cast(t)
    papers = authorships.join(publications.select("publication_id", "conference_id"), "publication_id").select("author_id", "publication_id", none().alias("role_id"), none().alias("position"), "conference_id", "affiliation")
    served = roles.select("author_id", none().alias("publication_id"), F.col("role_id").cast("string"), "position", "conference_id", "affiliation")
    return papers.unionByName(served)


def author_stats(authors: DataFrame, seen: DataFrame, conferences: DataFrame) -> DataFrame:
    """One row an author: counts of publications, roles and leading roles, venues, first and last year, latest affiliation.

    Leading roles are chair and co_chair. venues is null, not empty, for authors without any. The affiliation is that of the
    latest year; a publication wins over a committee, then the smallest id; blank ones don't count and authors.affiliation
    fills a gap. Authors without appearances have zeros and nulls.
    """
    conf = conferences.select("conference_id", "venue", "year")
    rows = seen.join(conf, "conference_id", "left")
    leading = F.col("position").isin("chair", "co_chair")
    # max_by over an ordered key: later year, then paper before role, then smaller id
    key = F.struct(F.coalesce("year", F.lit(-1)).alias("y"), F.col("publication_id").isNotNull().alias("p"))
    has = F.col("affiliation").isNotNull() & (F.col("affiliation") != "")
    best = rows.where(has).groupBy("author_id", key.alias("k")).agg(F.min_by("affiliation", F.coalesce("publication_id", "role_id")).alias("a"))
    best = best.groupBy("author_id").agg(F.max_by("a", "k").alias("recent"))
    # a publication and a role come once in an author's appearances, so that counts need no distinct
    agg = rows.groupBy("author_id").agg(
        F.count("publication_id").alias("publication_count"), F.count("role_id").alias("committee_role_count"), F.count(F.when(leading, F.col("role_id"))).alias("leadership_count"),
        F.array_sort(F.collect_set("venue")).alias("venues"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    out = authors.select("author_id", "affiliation").join(agg, "author_id", "left").join(best, "author_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("author_id", zero("publication_count"), zero("committee_role_count"), zero("leadership_count"), F.when(F.size("venues") > 0, F.col("venues")).alias("venues"), "first_year", "last_year", F.coalesce("recent", "affiliation").alias("recent_affiliation"))


def conference_stats(conferences: DataFrame, publications: DataFrame, roles: DataFrame, authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """One row a conference: publications by type, awards, roles, authors of its papers, acceptance rate in per cent.

    Publications, roles and authors are counted apart and joined, so that none multiplies another. committee_member_count
    counts roles, unique_author_count known authors of papers. The rate is acceptance_count (a column of ``conferences``; null
    where that has none) over submission_count as a decimal of one place, halves up, and null without either.
    """
    t = lambda x: F.count(F.when(F.col("paper_type") == x, 1))
    pubs = publications.groupBy("conference_id").agg(F.count("*").alias("publication_count"), t("regular").alias("regular_count"), t("invited").alias("invited_count"), F.count("award").alias("award_count"))
    served = roles.groupBy("conference_id").agg(F.count("*").alias("committee_member_count"))
    wrote = authorships.join(publications.select("publication_id", "conference_id"), "publication_id").join(authors.select("author_id"), "author_id", "left_semi")
    wrote = wrote.groupBy("conference_id").agg(F.count_distinct("author_id").alias("unique_author_count"))
    accepted = F.col("acceptance_count").cast("long") if "acceptance_count" in conferences.columns else F.lit(None).cast("long")
    out = conferences.select("conference_id", "venue", "year", "submission_count", accepted.alias("acceptance_count"))
    for part in (pubs, served, wrote):
        out = out.join(part, "conference_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("publication_count", "regular_count", "invited_count", "award_count", "committee_member_count", "unique_author_count")]
    s, a = F.col("submission_count").cast("decimal(18,0)"), F.col("acceptance_count").cast("decimal(18,0)")
    rate = F.when(s > 0, F.round(a * 100 / s, 1).cast("decimal(6,1)"))
    return out.select("conference_id", "venue", "year", "submission_count", *counts, "acceptance_count", rate.alias("acceptance_rate"))


def ordered_authors(authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """(publication_id, authors): names of each publication's authors in their order, parted by semicolons."""
    named = authorships.join(authors.select("author_id", "full_name"), "author_id").where("publication_id is not null")
    one = named.groupBy("publication_id").agg(F.array_sort(F.collect_list(F.struct("author_position", "authorship_id", "full_name"))).alias("a"))
    return one.select("publication_id", F.array_join(F.transform("a", lambda s: s["full_name"]), "; ").alias("authors"))


def author_lists(authorships: DataFrame, authors: DataFrame, presenters: DataFrame) -> DataFrame:
    """(publication_id, people): array<struct<slug, name, is_speaker>> of each publication's authors in their order.

    authorships: (publication_id, author_id, author_position); authors: (author_id, slug, full_name); presenters:
    (publication_id, presenter_author_id). Ties of place go by id; without a presenter nobody is the speaker.
    """
    named = authorships.join(authors.select("author_id", "slug", "full_name"), "author_id").join(presenters, "publication_id", "left")
    entry = F.struct("author_position", "author_id", "slug", F.col("full_name").alias("name"), F.coalesce(F.col("author_id") == F.col("presenter_author_id"), F.lit(False)).alias("is_speaker"))
    one = named.groupBy("publication_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))
    return one.select("publication_id", F.transform("a", lambda s: F.struct(s["slug"].alias("slug"), s["name"].alias("name"), s["is_speaker"].alias("is_speaker"))).alias("people"))


#: Orders of display in timelines (fixed values).
VENUE_ORDER = ("QIP", "QCRYPT", "TQC")


def timeline(seen: DataFrame, publications: DataFrame, conferences: DataFrame) -> DataFrame:
    """(author_id, year, papers, roles, qip, qcrypt, tqc): contributions in each year from the first to the last, none left out.

    Posters are no talks and don't count. Authors without a dated appearance have no row.
    """
    talks = seen.join(publications.select("publication_id", "paper_type"), "publication_id", "left").where("publication_id is null or paper_type is null or paper_type <> 'poster'")
    dated = talks.join(conferences.select("conference_id", "venue", "year"), "conference_id")
    venue = lambda v: F.count_distinct(F.when(F.col("venue") == v, F.col("publication_id")))
    per = dated.groupBy("author_id", "year").agg(F.count_distinct("publication_id").alias("papers"), F.count_distinct("role_id").alias("roles"), *[venue(v).alias(v.lower()) for v in VENUE_ORDER])
    span = per.groupBy("author_id").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(per, ["author_id", "year"], "left").na.fill(0)


def coverage(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Rows of each group and how many of them have a value, neither null nor empty, in each column."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count(F.nullif(F.col(c), F.lit(""))).alias(f"n_{c}") for c in columns])


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables of drifting columns one under the other; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
