"""Authors found, created and merged by normalized name; slugs; keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions import names as N
from biblioweave.operators.ranks import numbered


def assign_slugs(authors: DataFrame, key: str = "author_id") -> DataFrame:
    """(``key``, slug): a unique slug for each author, the oldest of equal names without a number.

    ``-2``, ``-3`` and so on tell equal names apart; where such a slug is itself the natural one of another author, that
    author keeps it and the number goes on, so that slugs are unique. Rows need full_name, family_name, given_name, created_at.
    """
    based = authors.select(key, "created_at", N.base_slug(F.col("family_name"), F.col("given_name"), F.col("full_name")).alias("base"))
    first = numbered(based, ["base"], [F.col("created_at"), F.col(key)], "n")
    plain = first.where("n = 1").select("base").withColumnRenamed("base", "taken")
    later = first.where("n > 1")
    # natural slugs that look like a numbered one of this base push its numbers on
    clash = plain.withColumn("of", F.regexp_extract("taken", "^(.*)-(\\d+)$", 1)).withColumn("k", F.regexp_extract("taken", "-(\\d+)$", 1).try_cast("long")).where("k >= 2")
    blocked = clash.groupBy("of").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    free = later.join(blocked, F.col("base") == F.col("of"), "left")
    number = F.aggregate(F.coalesce("ks", F.array().cast("array<long>")), F.col("n"), lambda acc, k: F.when(k <= acc, acc + 1).otherwise(acc))
    return first.where("n = 1").select(key, F.col("base").alias("slug")).union(free.select(key, F.concat_ws("-", "base", number.cast("string"))))


def sticky_slugs(authors: DataFrame, taken: DataFrame, key: str = "author_id") -> DataFrame:
    """(``key``, slug): slugs of new authors that clash with none of ``taken`` (a table with slug), which never change.

    A base that is taken, or has taken numbers, goes on from the largest number there is.
    """
    based = authors.select(key, "created_at", N.base_slug(F.col("family_name"), F.col("given_name"), F.col("full_name")).alias("base"))
    number = F.coalesce(F.regexp_extract("slug", "-(\\d+)$", 1).try_cast("long"), F.lit(1))
    bases = taken.select(F.explode(F.array_distinct(F.array(F.struct(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n")), F.struct(F.regexp_replace("slug", "-\\d+$", "").alias("base"), number.alias("n"))))).alias("b"))
    last = bases.groupBy(F.col("b.base").alias("base")).agg(F.max("b.n").alias("last_"))
    placed = numbered(based, ["base"], [F.col("created_at"), F.col(key)], "n_").join(last, "base", "left")
    n = F.col("n_") + F.coalesce("last_", F.lit(0))
    return placed.select(key, F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("slug"))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("first_", F.row_number().over(w)).where("first_ = 1").drop("first_")


def canonical_keys(rows: DataFrame, key: str, by_file: Column | None = None) -> DataFrame:
    """``rows`` with canonical_key ``VENUEYEAR-type-n``, n counted within (file,) venue, year and type in order of ``key``."""
    file = F.lit("") if by_file is None else by_file
    counted = numbered(rows.withColumn("file_", file), ["venue", "year", "paper_type", "file_"], [F.col(key)], "n_")
    name = F.concat(F.col("venue"), F.col("year").cast("string"), F.lit("-"), F.col("paper_type"), F.lit("-"), F.col("n_").cast("string"))
    return counted.withColumn("canonical_key", name).drop("file_", "n_")


def get_or_create(mentions: DataFrame, authors: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(name_key, author_id, is_new, first_name, affiliation): the author of every distinct name among ``mentions``.

    mentions: (name, affiliation, load_order). A name is found by the normalized name of an author, else by a variant
    (smallest id on a tie), else one author is created for the key, named as in its first mention; the affiliation is the last that
    isn't blank. New ids are a digest of the key, so that a second run creates nothing new.
    """
    m = mentions.withColumn("name_key", N.normalize_name(F.col("name"))).where("name_key <> ''")
    has = F.when(F.trim("affiliation") != "", F.col("affiliation"))
    one = m.groupBy("name_key").agg(F.min_by("name", "load_order").alias("first_name"), F.max_by(has, F.when(has.isNotNull(), F.col("load_order"))).alias("affiliation"))
    known = authors.select(N.normalize_name(F.col("full_name")).alias("name_key"), F.col("author_id").alias("id"), F.lit(0).alias("rank"))
    if variants is not None:
        known = known.union(variants.select(F.col("variant").alias("name_key"), F.col("author_id").alias("id"), F.lit(1).alias("rank")))
    known = known.groupBy("name_key").agg(F.min(F.struct("rank", "id")).alias("k"))
    out = one.join(known, "name_key", "left")
    return out.select("name_key", F.coalesce("k.id", F.md5("name_key")).alias("author_id"), F.col("k").isNull().alias("is_new"), "first_name", "affiliation")


def richness(full_name: Column, has_id: Column) -> Column:
    """Ordered mark of how much a spelling tells: an identifier, words, a middle initial, letters beyond ASCII."""
    w = N.words(full_name)
    return F.struct(has_id.cast("int").alias("a"), F.size(w).alias("b"), F.exists(w, lambda x: x.rlike("^.\\.$")).cast("int").alias("c"), full_name.rlike("[^\\x00-\\x7f]").cast("int").alias("d"))


def merge_plan(authors: DataFrame, fix_honorifics: bool = False) -> DataFrame:
    """(author_id, canonical_id, name_key): which author each duplicate merges into, by the importer's form of the name.

    The richest spelling stays, the smallest id on a tie; an author with an ``orcid`` (where the table has that column) is
    richer than any without. Only duplicates have a row. Empty names are no group.
    """
    has_id = F.coalesce(F.trim("orcid") != "", F.lit(False)) if "orcid" in authors.columns else F.lit(False)
    keyed = authors.select("author_id", "full_name", has_id.alias("has_id_"), N.importer_name(F.col("full_name"), fix_honorifics).alias("name_key")).where("name_key <> ''")
    keyed = keyed.withColumn("rich_", richness(F.col("full_name"), F.col("has_id_")))
    best = keyed.groupBy("name_key").agg(F.max("rich_").alias("r"), F.count("*").alias("n")).where("n > 1")
    tops = keyed.join(best, "name_key").where(F.col("rich_") == F.col("r")).groupBy("name_key").agg(F.min("author_id").alias("canonical_id"))
    return keyed.join(tops, "name_key").where("author_id <> canonical_id").select("author_id", "canonical_id", "name_key")


def _moved(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the author each goes to, and moved_: whether that is another."""
    moved = rows.join(plan.select("author_id", "canonical_id"), "author_id", "left").withColumn("moved_", F.col("canonical_id").isNotNull())
    return moved.withColumn("author_id", F.coalesce("canonical_id", "author_id")).drop("canonical_id")


def merge_authorships(authorships: DataFrame, plan: DataFrame) -> DataFrame:
    """Authorships with duplicates' rows given to the canonical author; of several rows of a publication the canonical's own stays, else the first."""
    return keep_first(_moved(authorships, plan), [F.col("publication_id"), F.col("author_id")], [F.col("moved_"), F.col("author_position"), F.col("authorship_id")]).drop("moved_")


def merge_roles(roles: DataFrame, plan: DataFrame) -> DataFrame:
    """Committee roles (role_id, conference_id, author_id, committee, position, ...) given to the canonical author.

    Of several rows of one conference, author, committee and position the canonical's own stays, else the smallest role_id.
    """
    keys = [F.col(c) for c in ("conference_id", "author_id", "committee", "position")]
    return keep_first(_moved(roles, plan), keys, [F.col("moved_"), F.col("role_id")]).drop("moved_")


def merge_variants(variants: DataFrame, plan: DataFrame, authors: DataFrame) -> DataFrame:
    """(author_id, variant_name, normalized_variant, variant_type) after a merge: variants move along, and each duplicate's spelling is a new one.

    Of several variants of one author and normalized form the author's own stays, then a moved one, then a new one.
    """
    moved = _moved(variants, plan).select("author_id", "variant_name", "normalized_variant", "variant_type", F.when(F.col("moved_"), 1).otherwise(0).alias("order_"))
    new = plan.join(authors.select("author_id", "full_name"), "author_id")
    new = new.select(F.col("canonical_id").alias("author_id"), F.col("full_name").alias("variant_name"), F.col("name_key").alias("normalized_variant"), F.lit("alternate_spelling").alias("variant_type"), F.lit(2).alias("order_"))
    return keep_first(moved.union(new), [F.col("author_id"), F.col("normalized_variant")], [F.col("order_"), F.col("variant_name")]).drop("order_")


def merge_authors(authors: DataFrame, plan: DataFrame) -> DataFrame:
    """Authors without those that were merged into another."""
    return authors.join(plan.select("author_id"), "author_id", "left_anti")


def match_person(candidate: Column, authors: Column) -> Column:
    """struct(matched, confidence) of a name among an array of authors: exact, family_only, ambiguous or none.

    A name whose words are among an author's, or the other way round, or the same last word, is family_only if one
    author only fits, ambiguous if several do.
    """
    nc = N.importer_name(candidate)
    every = F.transform(authors, lambda a: F.struct(a.alias("name"), N.importer_name(a).alias("key")))
    once = F.filter(every, lambda s, i: F.array_position(F.transform(every, lambda t: t["key"]), s["key"]) == i + 1)
    exact = F.filter(once, lambda s: s["key"] == nc)
    sub = lambda a, b: F.size(F.array_except(F.split(a, " "), F.split(b, " "))) == 0
    subset = F.filter(once, lambda s: sub(nc, s["key"]) | sub(s["key"], nc))
    last = lambda x: F.substring_index(x, " ", -1)
    family = F.filter(once, lambda s: (s["key"] != "") & (last(s["key"]) == last(nc)))
    make = lambda name, c: F.struct(name.cast("string").alias("matched"), F.lit(c).alias("confidence"))
    none = F.lit(None)
    one = lambda a: F.get(a, F.lit(0))["name"]
    return (
        F.when(nc == "", make(none, "none")).when(F.size(exact) > 0, make(one(exact), "exact")).when(F.size(subset) == 1, make(one(subset), "family_only")).when(F.size(subset) > 1, make(none, "ambiguous"))
        .when(F.size(family) == 1, make(one(family), "family_only")).when(F.size(family) > 1, make(none, "ambiguous")).otherwise(make(none, "none"))
    )
