"""Near-duplicate images across splits: exact Hamming distance by banding.

Equal hashes are one class first: classes are compared and not images, so a hash that very many images share
(a plain image has hash 0) is one row. If two hashes differ in at most d bits, then of d + PAIRED bands at least
PAIRED are equal in both; so an equi-join on PAIRED of the bands finds every pair of classes, and bit_count
of the difference decides. Two bands out of d + 2 make keys of about 2 * 64 / (d + 2) bits, 21 at d = 4,
where one band of d + 1 would make 13.
"""

from __future__ import annotations

from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRED = 2


def near_pairs(hashes: DataFrame, max_distance: int = 4, bits: int = 64) -> DataFrame:
    """hashes(id, split, h) → (id_a, split_a, id_b, split_b, distance), id_a < id_b, of different splits."""
    n = max_distance + PAIRED
    size = -(-bits // n)
    masks = [((1 << size) - 1) << (k * size) & ((1 << 64) - 1) for k in range(n)]
    keys = [sum(masks[k] for k in c) for c in combinations(range(n), PAIRED)]
    keys = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in keys]

    # read three times below, and often dear to make
    hashes = hashes.select("id", "split", "h").persist(StorageLevel.MEMORY_AND_DISK)
    classes = hashes.select("h").distinct()
    rows = classes.select("h", F.inline(F.array(*(F.struct(F.lit(k).alias("band"), F.col("h").bitwiseAND(m).alias("value")) for k, m in enumerate(keys)))))
    a, b = rows.alias("a"), rows.alias("b")
    diff = F.col("a.h").bitwiseXOR(F.col("b.h"))

    def same(mask: Column) -> Column:
        return diff.bitwiseAND(mask) == 0

    # of the keys a pair has in common only the first gives the pair
    earlier = F.lit(False)
    for k, m in enumerate(keys[:-1]):
        earlier |= (F.col("a.band") > k) & same(m)
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.h") < F.col("b.h")) & (F.bit_count(diff) <= max_distance) & ~earlier
    near = a.hint("merge").join(b, on).select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb"), F.bit_count(diff).alias("distance"))
    every = near.union(near.select("hb", "ha", "distance")).union(classes.select("h", "h", F.lit(0)))
    one, two = (hashes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "split", "h"))) for s in "ab")
    # every table here grows with the input, so none is broadcast through the driver
    pairs = one.hint("merge").join(every, one["h_a"] == every["ha"]).hint("merge").join(two, (two["h_b"] == F.col("hb")) & (F.col("id_a") < F.col("id_b")) & (F.col("split_a") != F.col("split_b")))
    return pairs.select("id_a", "split_a", "id_b", "split_b", "distance")


def by_distance(pairs: DataFrame) -> DataFrame:
    """pairs with place, 1 for the nearest; ties by the two ids."""
    from .search import ranked

    # there are few distances: a number as tie lets the pairs of one be dealt out by it
    return ranked(pairs.withColumn("nearness", -F.col("distance").cast("double")), "nearness", "id_a", "place", then=("id_b",)).drop("nearness")


def involved(pairs: DataFrame) -> DataFrame:
    """Images of each split that are in some pair."""
    sides = pairs.select(F.col("split_a").alias("split"), F.col("id_a").alias("id")).union(pairs.select("split_b", "id_b"))
    return sides.groupBy("split").agg(F.count_distinct("id").alias("images"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.least("split_a", "split_b").alias("split_a"), F.greatest("split_a", "split_b").alias("split_b")).agg(F.count("*").alias("pairs"))
