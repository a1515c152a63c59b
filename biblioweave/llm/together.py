"""Items that appear together: exact pair counts by an external sort of packed 64-bit pair codes.

Items get dense codes in the order of their ids, a pair is one 64-bit number (smaller code in the high half), and the
pairs of all baskets are sorted: every task packs and sorts a run in memory and counts equal codes by run length, the
runs spill to the shuffle, and the sorted merge of all runs adds the counts of equal codes. Measures of how far a pair
exceeds chance are then taken from its 2x2 table, with a continuity correction of one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioweave.session import broadcast_if_measured, cut

#: Members of a basket in one tile; longer baskets are cut into tiles, and pairs of tiles go to different tasks.
TILE = 256
#: Pair codes held in memory before a run is sorted and counted (8 bytes each).
RUN = 2_000_000


def memberships(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(b_, i_): which item is in which basket, once; rows with a null in either are left out."""
    return df.select(F.col(f"`{basket}`").alias("b_"), F.col(f"`{item}`").alias("i_")).where("b_ is not null and i_ is not null").distinct()


def _coded(items: DataFrame) -> DataFrame:
    """``items`` (i_, n_) with code_, dense in the order of i_, numbered by range partition: no single sorted task."""
    parts = cut(items.repartitionByRange("i_").sortWithinPartitions("i_").withColumn("row_", F.monotonically_increasing_id()))
    part = F.shiftright("row_", 33)
    sizes = parts.groupBy(part.alias("p")).count().collect()  # one row a partition
    starts, at = [], 0
    for p, n in sorted((r["p"], r["count"]) for r in sizes):
        starts.append((p, at))
        at += n
    if at >= 1 << 31:
        raise ValueError("more than 2^31 items don't fit half a pair code")
    table = F.create_map(*[F.lit(x) for kv in starts or [(0, 0)] for x in kv])
    return parts.withColumn("code_", F.try_element_at(table, part.cast("int")) + F.col("row_").bitwiseAND((1 << 33) - 1)).drop("row_")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, run-length counted runs of pair codes from tiles (a_, b_, same_)."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        codes = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(np.diff(np.r_[first, len(codes)]))], names=["pair_", "c_"])

    for batch in batches:
        left, right, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for k in range(batch.num_rows):
            x = left[k].values.to_numpy(zero_copy_only=False)
            if same[k]:
                i, j = np.triu_indices(len(x), 1)
                lo, hi = x[i], x[j]
            else:
                y = right[k].values.to_numpy(zero_copy_only=False)
                lo, hi = np.repeat(x, len(y)), np.tile(y, len(x))
            held.append(np.minimum(lo, hi) << 32 | np.maximum(lo, hi))
            size += len(lo)
            if size >= RUN:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal codes added up in a sorted stream of counted runs; the last code of a batch waits for the next."""
    last_code = last_count = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        codes, counts = codes[first], np.add.reduceat(counts, first)
        if last_code is not None:
            if codes[0] == last_code:
                counts[0] += last_count
            else:
                codes, counts = np.r_[last_code, codes], np.r_[last_count, counts]
        last_code, last_count = codes[-1], counts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(counts[:-1])], names=["pair_", "n_ab_"])
    if last_code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(last_code)], pa.int64()), pa.array([int(last_count)], pa.int64())], names=["pair_", "n_ab_"])


def pair_counts(members: DataFrame, least: int = 1, most_share: float | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(pairs, items, baskets): pairs (a_, b_, n_ab_) of codes with n_ab_ >= least, items (i_, n_, code_), number of baskets.

    ``most_share`` leaves out items in more than that share of the baskets; both bounds only leave out items that
    can't be in a wanted pair, so that the counts of the pairs kept are exact.
    """
    members = cut(members)
    baskets = members.select(F.count_distinct("b_")).first()[0]
    items = members.groupBy("i_").agg(F.count("*").alias("n_")).where(F.col("n_") >= least)
    if most_share is not None:
        items = items.where(F.col("n_") <= F.lit(most_share * baskets))
    items = cut(_coded(items))
    known = broadcast_if_measured(items.select("i_", "code_"))
    coded = members.join(known, "i_").select("b_", "code_")
    # only long baskets are cut into tiles, by a hash of the code; each pair of tiles is a task's unit of work
    sizes = cut(coded.groupBy("b_").agg(F.count("*").alias("k_")).where(F.col("k_") > TILE))
    tiled = coded.join(broadcast_if_measured(sizes), "b_", "left").withColumn("tile_", F.coalesce(F.pmod(F.xxhash64("code_"), F.ceil(F.col("k_") / TILE)), F.lit(0)).cast("int"))
    tiles = tiled.groupBy("b_", "tile_").agg(F.collect_list("code_").alias("codes_"), F.max("k_").alias("k_"))
    small = tiles.where(F.col("k_").isNull() & (F.size("codes_") > 1)).select(F.col("codes_").alias("a_"), F.array().cast("array<long>").alias("b_"), F.lit(True).alias("same_"))
    # only tiles of long baskets pair up: the tile numbers of a basket are few, and each row is a tile, not a member
    long = tiles.where(F.col("k_").isNotNull())
    inside = long.select(F.col("codes_").alias("a_"), F.array().cast("array<long>").alias("b_"), F.lit(True).alias("same_"))
    with_next = long.withColumn("other_", F.explode(F.sequence(F.lit(0), F.ceil(F.col("k_") / TILE).cast("int") - 1))).where("other_ > tile_")
    right = long.select(F.col("b_").alias("rb_"), F.col("tile_").alias("rt_"), F.col("codes_").alias("rc_"))
    across = with_next.join(right.hint("merge"), (F.col("b_") == F.col("rb_")) & (F.col("other_") == F.col("rt_"))).select(F.col("codes_").alias("a_"), F.col("rc_").alias("b_"), F.lit(False).alias("same_"))
    work = small.union(inside.union(across).repartition("a_", "b_"))
    runs = work.mapInArrow(_runs, "pair_ long, c_ long")
    # the shuffle's external sorter merges the runs of a partition, spilling as it must; equal codes then stand together
    sorted_runs = runs.repartition("pair_").sortWithinPartitions("pair_")
    pairs = sorted_runs.mapInArrow(_merged, "pair_ long, n_ab_ long").where(F.col("n_ab_") >= least)
    half = F.lit((1 << 32) - 1)
    return pairs.select(F.shiftright("pair_", 32).alias("a_"), F.col("pair_").bitwiseAND(half).alias("b_"), "n_ab_"), items, baskets


def associations(df: DataFrame, basket: str, item: str, least: int = 1, least_lift: float | None = None) -> DataFrame:
    """(``item``_a, ``item``_b, n_a, n_b, n_ab, n, lift, odds_ratio, log_odds_z) of pairs that share ``least`` baskets or more.

    An item counts once in a basket; nulls are left out; n counts the baskets with an item. ``least_lift`` keeps pairs
    with n_ab * n >= least_lift * n_a * n_b; items too frequent for any such pair are left out before pairs are made.
    odds_ratio has one half added to each cell of the 2x2 table; log_odds_z is its logarithm over its standard error.
    The smaller id comes first (by code points). An empty table gives no pair.
    """
    share = None if not least_lift else 1.0 / least_lift
    pairs, items, n = pair_counts(memberships(df, basket, item), least, share)
    small = items.select("i_", "n_", "code_")
    left, right = broadcast_if_measured(small.toDF("ia_", "na_", "a_")), broadcast_if_measured(small.toDF("ib_", "nb_", "b_"))
    out = pairs.join(left, "a_").join(right, "b_").withColumn("t_", F.lit(n).cast("long"))
    if least_lift:
        out = out.where(F.col("n_ab_") * F.col("t_") >= F.lit(least_lift) * F.col("na_") * F.col("nb_"))
    h = F.lit(0.5)
    p, q, r, s = F.col("n_ab_") + h, F.col("na_") - F.col("n_ab_") + h, F.col("nb_") - F.col("n_ab_") + h, F.col("t_") - F.col("na_") - F.col("nb_") + F.col("n_ab_") + h
    odds = p * s / (q * r)
    return out.select(
        F.col("ia_").alias(f"{item}_a"), F.col("ib_").alias(f"{item}_b"), F.col("na_").alias("n_a"), F.col("nb_").alias("n_b"), F.col("n_ab_").alias("n_ab"), F.col("t_").alias("n"),
        (F.col("n_ab_") * F.col("t_") / (F.col("na_") * F.col("nb_"))).alias("lift"), odds.alias("odds_ratio"),
        (F.log(odds) / F.sqrt(1 / p + 1 / q + 1 / r + 1 / s)).alias("log_odds_z"),
    )
