"""Documents of several sources mixed to target shares of all tokens, by a low-discrepancy schedule of equal blocks.

Slot i gets the point frac(i * golden ratio) in [0, 1), and the cumulative target shares map the point to a source, so
that every stretch of the schedule holds each source in its share. The shuffled documents of a source, repeated as often as
its share asks for, are cut into blocks of equal tokens, and its k-th slot takes the k-th block; the last block ends where
the source has its share. Ranks and running token sums are taken in two levels (within buckets, then over bucket
totals), never in one task a source.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.session import cut

#: Vocabulary of a public byte-level tokenizer, as ranks; a parameter of the functions below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer cuts texts into words (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN = 0.6180339887498949
#: Slots whose ranks are taken in one go, and documents whose running sums are.
CHUNK, BUCKET = 1 << 16, 50_000
#: Characters after which a long text is cut at the next place where the tokenizer's words part whatever stands around it.
_SEGMENT = 200_000
_PARTS = re.compile(r"(?<=\S) (?=\S)")


def _segments(text: str) -> Iterator[str]:
    """The text in segments that have, one by one, the tokens of the whole: each but the first begins with the blank of a word."""
    at = 0
    while at < len(text):
        m = _PARTS.search(text, at + _SEGMENT)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def token_counts(df: DataFrame, column: str, vocabulary: str = VOCABULARY, into: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of the whole text in ``column``; 0 for null and empty texts.

    The vocabulary is read where the query is built and goes to the tasks; executors need no file.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            b[into] = [sum(len(encoding.encode_ordinary(x)) for x in _segments(t)) if t else 0 for t in b[column]]
            yield b

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{into}` long"
    return df.mapInPandas(run, schema)


def _point(i: Column) -> Column:
    """frac(i * golden ratio), exact enough for any 64-bit i: high and low parts of i are multiplied apart."""
    big = 1 << 24
    step = (big * GOLDEN) % 1.0
    high, low = F.floor(i / big), i % big
    return (high * step - F.floor(high * step) + low * GOLDEN) % 1.0


def _prefix(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, into: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before (by bucket, then order) in the same ``keys``: two levels."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("sum_"))
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base_", F.coalesce(F.sum("sum_").over(upto), F.lit(0))).drop("sum_")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [*keys, bucket]).withColumn(into, F.col("base_") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("base_")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None, block_tokens: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """(slot, doc_id, source, repeat, tokens, target_share, reached_share): the selection, one row a use of a document.

    docs needs doc_id, source and text; targets source, target_share and max_repeats. ``total`` tokens are selected, by
    default (and at most) as many as the shares and max_repeats allow. repeat counts the uses of a document from 1 and
    never exceeds max_repeats; reached_share is the source's share of all selected tokens. Rows in order of slot are the
    mixture; a slot holds a block of about ``block_tokens`` tokens. A source gets its share to within half a document. Null sources, sources without a target, and texts without tokens take no part; the shares of sources
    without documents go to the others in proportion. Documents with the same doc_id are drawn each for itself.
    """
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").toLocalIterator()}
    wanted = docs.where(F.col("source").isin(list(goal))).select("doc_id", "source", "text")
    sized = cut(token_counts(wanted, "text", vocabulary).select("doc_id", "source", "tokens").where("tokens > 0"))
    have = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}  # one row a source
    goal = {s: g for s, g in goal.items() if s in have}
    if not goal:
        return sized.select(F.lit(0).cast("long").alias("slot"), "doc_id", "source", F.lit(0).alias("repeat"), "tokens", F.lit(0.0).alias("target_share"), F.lit(0.0).alias("reached_share")).limit(0)
    whole = sum(g[0] for g in goal.values())
    share = {s: g[0] / whole for s, g in goal.items()}
    most = int(min(have[s][1] * goal[s][1] / share[s] for s in goal))
    budget = min(total or most, most)
    quota = {s: share[s] * budget for s in goal}
    names = sorted(goal)
    table = lambda f: F.create_map(*[F.lit(x) for s in names for x in (s, f(s))])
    at_source = lambda f: F.try_element_at(table(f), F.col("source"))

    # documents of a source in shuffled order, over and over up to its share: each in the block in which its first token falls
    drawn = sized.withColumn("h_", F.xxhash64("doc_id", "tokens", F.lit(seed)))
    drawn = drawn.withColumn("bucket_", F.pmod(F.xxhash64("h_"), at_source(lambda s: max(1, have[s][0] // BUCKET))))
    drawn = _prefix(drawn, ["source"], "bucket_", ["h_", "doc_id"], F.col("tokens"), "start_")
    laps = at_source(lambda s: min(goal[s][1], -(-int(quota[s]) // have[s][1]) + 1))
    drawn = drawn.withColumn("repeat", F.explode(F.sequence(F.lit(1), laps.cast("int"))))
    drawn = drawn.withColumn("start_", F.col("start_") + (F.col("repeat") - 1) * at_source(lambda s: have[s][1]))
    drawn = drawn.where(F.col("start_") + F.col("tokens") / 2 <= at_source(lambda s: quota[s]))
    drawn = drawn.select("doc_id", "source", "repeat", "tokens", F.floor(F.col("start_") / block_tokens).alias("rank_"))

    # slots mapped to sources through the cumulative shares, ranked within each. The count of a source among n slots is its
    # share of n but for a few (the discrepancy of the golden ratio grows with the logarithm of n): so many more are made
    edges, at = [], 0.0
    for s in names[:-1]:
        at += share[s]
        edges.append(at)
    slots_n = -(-budget // block_tokens)
    slots_n += math.ceil((4 + math.log2(slots_n + 2)) / min(share.values()))
    point = F.col("point_")
    which = F.lit(0)
    for e in edges:
        which = which + (point >= e).cast("int")
    slots = docs.sparkSession.range(slots_n).withColumnRenamed("id", "slot").withColumn("point_", _point(F.col("slot")))
    slots = slots.withColumn("source", F.try_element_at(F.array(*map(F.lit, names)), which + 1)).withColumn("chunk_", F.floor(F.col("slot") / CHUNK))
    slots = _prefix(slots.drop("point_"), ["source"], "chunk_", ["slot"], F.lit(1), "rank_").select("slot", "source", "rank_")

    chosen = cut(slots.join(drawn.hint("merge"), ["source", "rank_"]).select("slot", "doc_id", "source", "repeat", "tokens"))
    sums = chosen.groupBy("source").agg(F.sum("tokens").alias("t")).collect()  # one row a source
    reached = {r["source"]: r["t"] for r in sums}
    every = sum(reached.values()) or 1
    return chosen.select("slot", "doc_id", "source", "repeat", "tokens", at_source(lambda s: goal[s][0]).alias("target_share"), at_source(lambda s: reached.get(s, 0) / every).alias("reached_share"))


def shares(mixture: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, documents, uses, tokens, most_uses) of a selection made by ``mix``."""
    uses = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("u"), F.sum("tokens").alias("t"), F.max("target_share").alias("a"), F.max("reached_share").alias("b"))
    return uses.groupBy("source").agg(F.max("a").alias("target_share"), F.max("b").alias("reached_share"), F.count("*").alias("documents"), F.sum("u").alias("uses"), F.sum("t").alias("tokens"), F.max("u").alias("most_uses"))
