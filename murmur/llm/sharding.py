"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

1. The rows are written once, each with its partition and place in it; everything after is a function of that table,
   so repeated or recovered tasks see the same rows.
2. For each partition the numbers of rows it sends to every shard are drawn without replacement from the places left in
   the shards (multivariate hypergeometric): rows sum to the partition, columns to the exact shard sizes.
3. Each partition is permuted by a seeded hash; its first rows go to shard 0, and so on.
4. After the exchange each shard is permuted again. Slots are counted in bounded ranges of the hash, with offsets.

The matrix has partitions x shards counts; both are numbers of tasks, not of rows.

Defined cases: shard sizes differ by one at most (the first n mod shards are larger); no rows give no rows; repeated rows
are rows of their own; null values are kept; helper columns start with `_shard`, an own `shard` or `slot` is replaced."""

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from murmur.llm.shared import written

#: Rows that one range of a shard holds on average.
RANGE_ROWS = 50_000


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts[p, s] of a uniform random deal of all rows into shards whose sizes differ by one at most."""
    total, draw = sum(sizes), np.random.default_rng(seed)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    counts = np.zeros((len(sizes), shards), dtype=np.int64)
    for p, size in enumerate(sizes):
        rest, sent = int(left.sum()), int(size)
        for s in range(shards):  # one shard after the other: univariate draws work for any size
            others = rest - int(left[s])
            n = _hypergeometric(draw, int(left[s]), others, sent)
            counts[p, s], rest, sent = n, others, sent - n
        left -= counts[p]
    return counts


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """numpy's own draw holds below 1e9; above, the places drawn are counted (memory in proportion to one partition)."""
    if not sample or not good:
        return 0
    if max(good, bad) < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, sample))
    return int(np.count_nonzero(draw.choice(good + bad, sample, replace=False, shuffle=False) < good))


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Every row with `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard)."""
    placed = rows.drop("shard", "slot").select(
        "*", F.spark_partition_id().alias("_shard_part"), F.monotonically_increasing_id().alias("_shard_row")
    )
    placed = written(placed, "shard-rows")
    sizes = sorted((r["_shard_part"], r["n"]) for r in placed.groupBy("_shard_part").agg(F.count("*").alias("n")).collect())
    counts = communication_matrix([n for _, n in sizes], shards, seed)
    ends = rows.sparkSession.createDataFrame(
        [(part, ends) for (part, _), ends in zip(sizes, counts.cumsum(axis=1).tolist())], "_shard_part int, _shard_ends array<bigint>"
    )
    keys = placed.select("_shard_part", "_shard_row")  # the payload stays where it is until the slots are known
    local = Window.partitionBy("_shard_part").orderBy(F.xxhash64(F.lit(seed), "_shard_row"), "_shard_row")
    dealt = keys.withColumn("_shard_rank", F.row_number().over(local)).join(ends, "_shard_part").withColumn(
        "shard", F.expr("size(filter(_shard_ends, e -> e < _shard_rank))")
    )
    ranges = max(1, -(-sum(n for _, n in sizes) // (shards * RANGE_ROWS)))
    again = F.xxhash64(F.lit(seed + 1), "_shard_row")
    dealt = written(dealt.select(
        "_shard_row", "shard", again.alias("_shard_key"), F.pmod(F.shiftright(again, 20), F.lit(ranges)).alias("_shard_range")
    ), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("_shard_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "_shard_range").agg(F.count("*").alias("n")).select(
        "shard", "_shard_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_offset")
    )
    inside = Window.partitionBy("shard", "_shard_range").orderBy("_shard_key", "_shard_row")
    slots = dealt.withColumn("_shard_at", F.row_number().over(inside)).join(offsets, ["shard", "_shard_range"]).select(
        "_shard_row", "shard", (F.col("_shard_offset") + F.col("_shard_at") - 1).cast("long").alias("slot")
    )
    return placed.join(slots, "_shard_row").drop("_shard_row", "_shard_part")
