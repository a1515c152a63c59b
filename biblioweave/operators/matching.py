"""Titles matched to schedules and recordings: candidates by shared words, scores, greedy one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions import names as N
from biblioweave.operators.ranks import carried
from biblioweave.session import cut

#: Scores of a confident match and of one that counts at all, and what each of two matching authors adds (fixed values).
CONFIDENT, WEAK, PER_AUTHOR = 0.62, 0.45, 0.15


def title_candidates(left: DataFrame, right: DataFrame, block: list[str], least: float = WEAK) -> DataFrame:
    """(left_id, right_id, *block, score): pairs of titles in the same block with a Jaccard score of ``least`` or more.

    left and right: (id, *block, title). Pairs meet at a shared word, which loses none as the score of titles without one
    is 0; only the rarest words that a pair of this score must share are used (prefix filter), so that frequent words
    make no large groups. Titles without words match nothing.
    """
    a = left.select(F.col("id").alias("left_id"), *block, N.title_tokens(F.col("title")).alias("a")).where(F.size("a") > 0)
    b = right.select(F.col("id").alias("right_id"), *block, N.title_tokens(F.col("title")).alias("b")).where(F.size("b") > 0)
    words = a.select(F.explode("a").alias("w")).union(b.select(F.explode("b").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, key: str, col: str) -> DataFrame:
        # the first |x| - ceil(least * |x|) + 1 words in a common order by rarity must hold a shared one
        ranked = df.select(key, *block, F.col(col).alias("t"), F.explode(col).alias("w")).join(words, "w")
        w = Window.partitionBy(key, *block).orderBy("n", "w")
        keep = F.size("t") - F.ceil(least * F.size("t")) + 1
        return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select(key, *block, "w")

    pairs = prefix(a, "left_id", "a").join(prefix(b, "right_id", "b"), [*block, "w"]).select("left_id", "right_id", *block).distinct()
    scored = pairs.join(a, ["left_id", *block]).join(b, ["right_id", *block]).withColumn("score", N.jaccard(F.col("a"), F.col("b")))
    return scored.where(F.col("score") >= least).select("left_id", "right_id", *block, "score")


def with_author_bonus(scored: DataFrame, authors: DataFrame, texts: DataFrame) -> DataFrame:
    """``scored`` with title_score (the score so far), overlap and score: title_score + PER_AUTHOR for each of two authors at most.

    authors: (left_id, names array), texts: (right_id, text). An author overlaps if the last word of the importer's form of the
    name is a word of the text. Missing authors or texts overlap with nothing.
    """
    last = authors.select("left_id", F.filter(F.transform("names", lambda a: F.substring_index(N.importer_name(a), " ", -1)), lambda x: x != "").alias("last_"))
    said = texts.select("right_id", F.regexp_extract_all(N.importer_name(F.col("text")), F.lit("([a-z0-9]+)")).alias("said_"))
    both = scored.join(last, "left_id", "left").join(said, "right_id", "left")
    overlap = F.coalesce(F.size(F.filter("last_", lambda x: F.array_contains("said_", x))), F.lit(0))
    out = both.withColumn("overlap", F.greatest(overlap, F.lit(0))).withColumnRenamed("score", "title_score")
    return out.withColumn("score", F.col("title_score") + PER_AUTHOR * F.least("overlap", F.lit(2))).drop("last_", "said_")


def greedy_assignment(scored: DataFrame, block: list[str], score: str = "score", confident: float = CONFIDENT) -> DataFrame:
    """(*block, left_id, right_id, score, confident): one-to-one pairs, best score first, within each block.

    Ties go to the larger title_score and overlap where the candidates have them, then to the larger left and right id. With
    such a total order the choice needs no queue: a pair that is the best of both its sides is chosen, the pairs of
    both sides go, and so on until none is left. Each round is two aggregations over all blocks at once.
    """
    marks = [c for c in ("title_score", "overlap") if c in scored.columns]
    order = F.struct(F.col(score), *[F.col(c) for c in marks], F.col("left_id"), F.col("right_id"))
    open_ = cut(scored.select(*block, "left_id", "right_id", F.col(score).cast("double").alias("score"), order.alias("o_")))
    chosen: DataFrame | None = None
    while not open_.isEmpty():
        left = open_.groupBy(*block, "left_id").agg(F.max("o_").alias("l_"))
        right = open_.groupBy(*block, "right_id").agg(F.max("o_").alias("r_"))
        best = cut(open_.join(left, [*block, "left_id"]).join(right, [*block, "right_id"]).where((F.col("o_") == F.col("l_")) & (F.col("o_") == F.col("r_"))).select(*block, "left_id", "right_id", "score"))
        chosen = best if chosen is None else chosen.union(best)
        open_ = cut(open_.join(best.select(*block, "left_id"), [*block, "left_id"], "left_anti").join(best.select(*block, "right_id"), [*block, "right_id"], "left_anti").select(*open_.columns))
    out = open_.select(*block, "left_id", "right_id", "score") if chosen is None else chosen
    return out.withColumn("confident", F.col("score") >= confident)


def best_schedule_match(talks: DataFrame, slots: DataFrame, block: list[str]) -> DataFrame:
    """(talk_id, slot_id, score): for each talk the slot that fits best; a slot may serve several talks.

    talks: (id, *block, title, arxiv_id), slots: (id, *block, title, arxiv_ids array). An id in common counts 100, the share
    of common words of the plain titles up to 50; 20 or less is no match; the smaller slot id wins a tie. Pairs meet at a
    shared id or word.
    """
    t = talks.select(F.col("id").alias("talk_id"), *block, F.array_distinct(N.words(N.title_plain(F.col("title")))).alias("a"), "arxiv_id")
    s = slots.select(F.col("id").alias("slot_id"), *block, F.array_distinct(N.words(N.title_plain(F.col("title")))).alias("b"), "arxiv_ids")
    # a score above 20 without a common id takes 0.4 of the words: the prefix filter of that share
    t_words = t.select("talk_id", *block, F.explode_outer("a").alias("w"))
    by_id = t.where(F.col("arxiv_id") != "").select("talk_id", *block, F.col("arxiv_id").alias("k")).join(s.select("slot_id", *block, F.explode("arxiv_ids").alias("k")), [*block, "k"]).select("talk_id", "slot_id", *block)
    freq = t_words.select("w").union(s.select(F.explode("b").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, key: str, col: str) -> DataFrame:
        ranked = df.select(key, *block, F.col(col).alias("x"), F.explode(col).alias("w")).join(freq, "w")
        w = Window.partitionBy(key, *block).orderBy("n", "w")
        return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.size("x") - F.ceil(0.4 * F.size("x")) + 1).select(key, *block, "w")

    by_word = prefix(t, "talk_id", "a").join(prefix(s, "slot_id", "b"), [*block, "w"]).select("talk_id", "slot_id", *block)
    pairs = by_id.union(by_word).distinct().join(t, ["talk_id", *block]).join(s, ["slot_id", *block])
    same = F.when((F.col("arxiv_id") != "") & F.array_contains("arxiv_ids", F.col("arxiv_id")), 100.0).otherwise(0.0)
    scored = pairs.withColumn("score", F.coalesce(same, F.lit(0.0)) + 50.0 * N.jaccard(F.col("a"), F.col("b"))).where("score > 20")
    w = Window.partitionBy("talk_id").orderBy(F.desc("score"), "slot_id")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("talk_id", "slot_id", "score")


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what a map filled in this order would hold."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("last_", F.row_number().over(w)).where("last_ = 1").drop("last_")


def carry_forward(df: DataFrame, by: list[str], order: str, column: str, into: str) -> DataFrame:
    """``df`` with the last non-empty value of ``column`` up to each row, as headings of a page govern the rows below."""
    return carried(df, by, [F.col(order)], F.nullif(F.col(column), F.lit("")), into)
