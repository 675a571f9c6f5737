"""Ranks over unbounded populations without funnelling them into one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmur.session import cut_lineage

_STEP = 1024.0


def order_bucket(value: Column) -> Column:
    """Monotone coarse code of a double: about a thousand codes per e-fold, so at most ~1.5 M overall."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * _STEP).cast("long")


#: Distinct values up to which a group is ranked as a whole; a larger one is ranked in two levels.
SMALL_GROUP = 50_000


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Distinct values per group with `_start` (rows sorted before), `_cnt` and `_n` (group size); `total`, a column, is summed.

    Rows are first reduced to value counts. Groups of at most `SMALL_GROUP` distinct values are then ranked in place. In
    larger ones the running count is taken in two levels, over the bounded coarse codes of a group and inside one code,
    so a huge group is spread over many tasks."""
    keys = list(by)
    sums = [F.sum(total).alias(total)] if total else []
    carried = [total] if total else []
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_cnt"), *sums)
    )
    if not keys:
        return _two_levels(counts, keys, carried)
    # rows bound the distinct values from above; a large group has many rows, so the list of them is short
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_rows"))
    large = F.broadcast(cut_lineage(rows.where(F.col("_rows") > SMALL_GROUP).select(*[F.col(k).alias(f"_l_{k}") for k in keys])))
    same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
    small = counts.join(large, same, "left_anti")
    of_group = W.partitionBy(*keys)
    before = of_group.orderBy("_value").rowsBetween(W.unboundedPreceding, -1)
    ranked = small.select(
        *keys, "_value", "_cnt", F.sum("_cnt").over(of_group).alias("_n"), F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_start"), *carried)
    return ranked.unionByName(_two_levels(counts.join(large, same, "left_semi"), keys, carried))


def _two_levels(counts: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    counts = counts.withColumn("_code", order_bucket(F.col("_value")))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    before = W.partitionBy(*group).orderBy("_code").rowsBetween(W.unboundedPreceding, -1)
    codes = (
        counts.groupBy(*keys, "_code").agg(F.sum("_cnt").alias("_code_rows"))
        .select(
            *keys, "_code",
            F.coalesce(F.sum("_code_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_code_rows").over(W.partitionBy(*group)).alias("_n"),
        )
    )
    inside = W.partitionBy(*keys, "_code").orderBy("_value").rowsBetween(W.unboundedPreceding, -1)
    return (
        counts.join(codes, [*keys, "_code"])
        .select(
            *keys, "_value", "_cnt", "_n",
            (F.col("_before") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0))).alias("_start"), *carried,
        )
    )


def percentile_table(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "score", total: str | None = None) -> DataFrame:
    """Average-rank percentile (0..100) of every distinct value; a lone row scores 50. `total` is summed per value."""
    position = F.col("_start") + (F.col("_cnt") - 1) / 2
    score = F.when(F.col("_n") == 1, F.lit(50.0)).otherwise(
        F.round(position / (F.col("_n") - 1) * 100, 6)
    )
    return rank_table(df, value, by, total).select(*by, F.col("_value"), score.alias(out), *([total] if total else []))


def with_percentile(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "score") -> DataFrame:
    """Attach the percentile of `value` within its group; null values get null."""
    table = percentile_table(df, value, by, out)
    keyed = df.withColumn("_value", F.col(value).cast("double"))
    return keyed.join(table, [*by, "_value"], "left").drop("_value")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The rank filter lets every map task keep only k rows per group
    before the shuffle, so the size of a group does not matter."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_overall(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows overall, numbered; the window runs over k rows only."""
    head = df.orderBy(*order).limit(k)
    return head.withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
