"""Queries of the operators for training data, over the whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import names as N
from biblioweave.llm import leakage, lookalike, mixing, mojibake, people, together
from biblioweave.operators import packed
from biblioweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_entities(spark: SparkSession, base: str) -> DataFrame:
    """The person or group of every spelling."""
    return people.resolve(table(spark, base, "name_spellings", "spelling_id", "name_text"), "spelling_id", "name_text")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """All pairs of spellings of the same person or group."""
    return people.linked_pairs(p1_entities(spark, base), "spelling_id")


def _unified(spark: SparkSession, base: str) -> DataFrame:
    parts = []
    for name, key, column in (("workshop", "record_id", "authors"), ("committees", "member_id", "full_name"), ("papers_compact", "paper_id", "title")):
        rows = lookalike.unify(table(spark, base, name, key, column), key, column)
        parts.append(rows.select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), "after"))
    return parts[0].union(parts[1]).union(parts[2])


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows whose authors, full_name or title isn't in plain composed letters."""
    return _unified(spark, base).select("table_name", "record_id")


def p5_unified(spark: SparkSession, base: str) -> DataFrame:
    """These rows with the text in its one form."""
    return _unified(spark, base).withColumnRenamed("after", "unified_text")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of authors with three joint publications or more, five times as many as chance gives or more."""
    found = together.associations(table(spark, base, "authorships", "publication_id", "author_id"), "publication_id", "author_id", least=3, least_lift=5.0)
    return found.select("author_id_a", "author_id_b")


def p6_associations(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of authors with two joint publications or more, and how far it exceeds chance."""
    found = together.associations(table(spark, base, "authorships", "publication_id", "author_id"), "publication_id", "author_id", least=2)
    return found.withColumns({"lift": F.round("lift", 6), "odds_ratio": F.round("odds_ratio", 4), "log_odds_z": F.round("log_odds_z", 6)})


def p6_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of authors with a joint publication, and how far it exceeds chance."""
    found = together.associations(table(spark, base, "authorships", "publication_id", "author_id"), "publication_id", "author_id")
    return found.withColumns({"lift": F.round("lift", 6), "odds_ratio": F.round("odds_ratio", 4), "log_odds_z": F.round("log_odds_z", 6)})


def p6_names(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of names that stand together in a workshop row, each name in one form."""
    names = packed.unpack(table(spark, base, "workshop", "record_id", "authors"), "record_id", {"authors": "person"})
    keyed = names.select("record_id", N.normalize_name(F.col("item")).alias("name")).where("name <> ''")
    found = together.associations(keyed, "record_id", "name")
    return found.withColumns({"lift": F.round("lift", 6), "odds_ratio": F.round("odds_ratio", 4), "log_odds_z": F.round("log_odds_z", 6)})


def p7_passages(spark: SparkSession, base: str) -> DataFrame:
    """The leaked items of every document, with the length of the longest passage and its edits."""
    return leakage.leaked(table(spark, base, "documents", "doc_id", "text"), table(spark, base, "eval_items", "item_id", "text"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that hold a passage of a held-out item."""
    return p7_passages(spark, base).select("doc_id", "item_id")


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of all sources mixed to their target shares of all tokens, with the shares reached."""
    docs = table(spark, base, "documents", "doc_id", "source", "text")
    return mixing.mix(docs, table(spark, base, "mix_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """Target and reached share of each source in that mixture."""
    return mixing.shares(p8_mix(spark, base))


def p9_restored(spark: SparkSession, base: str) -> DataFrame:
    """Documents with a stretch decoded with the wrong character table, restored as far as it can be."""
    return mojibake.repair(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with a stretch decoded with the wrong character table."""
    return p9_restored(spark, base).select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_entities, p5_found, p5_unified, p6_found, p6_associations, p6_pairs, p6_names, p7_found, p7_passages, p8_mix, p8_shares, p9_found, p9_restored)}


_PAIRS = """
WITH m AS (SELECT DISTINCT publication_id p, author_id a FROM authorships WHERE author_id IS NOT NULL AND publication_id IS NOT NULL),
c AS (SELECT a, count(*) n FROM m GROUP BY a), t AS (SELECT count(DISTINCT p) n FROM m),
j AS (SELECT x.a author_id_a, y.a author_id_b, count(*) n_ab FROM m x JOIN m y ON x.p = y.p AND x.a < y.a GROUP BY x.a, y.a),
s AS (SELECT author_id_a, author_id_b, ca.n n_a, cb.n n_b, n_ab, t.n n FROM j JOIN c ca ON ca.a = author_id_a JOIN c cb ON cb.a = author_id_b CROSS JOIN t)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _PAIRS + "SELECT author_id_a, author_id_b FROM s WHERE n_ab >= 3 AND n_ab * n >= 5 * n_a * n_b",
        "p6_associations": _PAIRS + """, o AS (SELECT *, n_ab + 0.5::DOUBLE p, n_a - n_ab + 0.5::DOUBLE q, n_b - n_ab + 0.5::DOUBLE r, n - n_a - n_b + n_ab + 0.5::DOUBLE u FROM s WHERE n_ab >= 2)
SELECT author_id_a, author_id_b, n_a, n_b, n_ab, n, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) lift, round(p * u / (q * r), 4) odds_ratio,
round(ln(p * u / (q * r)) / sqrt(1 / p + 1 / q + 1 / r + 1 / u), 6) log_odds_z FROM o""",
        "p6_pairs": _PAIRS + """, o AS (SELECT *, n_ab + 0.5::DOUBLE p, n_a - n_ab + 0.5::DOUBLE q, n_b - n_ab + 0.5::DOUBLE r, n - n_a - n_b + n_ab + 0.5::DOUBLE u FROM s)
SELECT author_id_a, author_id_b, n_a, n_b, n_ab, n, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) lift, round(p * u / (q * r), 4) odds_ratio,
round(ln(p * u / (q * r)) / sqrt(1 / p + 1 / q + 1 / r + 1 / u), 6) log_odds_z FROM o""",
    }
