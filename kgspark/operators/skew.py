"""Operators for tables in which a handful of keys hold most rows.

``weighted_profile`` is value-frequency compression: rows are grouped by (key, value) before key, so the
shuffle is spread over the values of a hot key and the second grouping sees at most one row per distinct
(key, value).  Distinct counts, modes and percentiles are then exact functions of the weighted values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import materialize


def compress(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None, **aggs: Column) -> DataFrame:
    """One row per (keys, value) with its frequency ``w``; map-side combined, spread by key *and* value."""
    w = F.sum(weight) if weight is not None else F.count(F.lit(1))
    return rows.groupBy(*keys, value).agg(w.alias("w"), *[c.alias(n) for n, c in aggs.items()])


def weighted_profile(rows: DataFrame, keys: list[str], value: str, percentiles: tuple[float, ...] = ()) -> DataFrame:
    """Per key from rows of (keys, value): rows, distinct non-null values, mode and exact percentiles.

    NULL values count in ``n`` but are neither a distinct value nor a mode; ties of the mode go to the
    smallest value.  A NULL key is a group of its own.  An empty input gives an empty result.
    """
    weighted = compress(rows, keys, value)
    return profile_of_weighted(weighted, keys, value, percentiles)


def profile_of_weighted(
    weighted: DataFrame, keys: list[str], value: str, percentiles: tuple[float, ...] = ()
) -> DataFrame:
    """Second step of ``weighted_profile``, for tables already compressed to (keys, value, w)."""
    # mode: the largest weight, ties to the smallest value; min over (-w, value) is map-side combinable
    mode = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("w")).alias("nw"), F.col(value).alias("v"))))
    aggs = [
        F.sum("w").alias("n"),
        F.count(value).alias("distinct_values"),
        mode["v"].alias("mode_value"),
        (-mode["nw"]).alias("mode_count"),
    ]
    if percentiles:
        aggs.append(F.percentile(F.col(value), list(percentiles), F.col("w")).alias("percentiles"))
    return weighted.groupBy(*keys).agg(*aggs)


def hot_keys(rows: DataFrame, key: str, fraction: float = 0.01) -> DataFrame:
    """Keys holding at least ``fraction`` of all rows: never more than 1/fraction of them."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col("n") >= F.lit(fraction) * total)).select(key, "n")


def hot_values(rows: DataFrame, key: str, fraction: float = 0.01) -> list:
    """The hot keys themselves: at most 1/fraction values, so they may come to the driver."""
    return [r[key] for r in hot_keys(rows, key, fraction).select(key).collect()]


def hot_split_join(left: DataFrame, right: DataFrame, key: str, fraction: float = 0.01, hot: list | None = None) -> DataFrame:
    """Inner join on ``key`` where ``left`` may be dominated by a few keys and ``right`` holds few rows of each.

    The rows of ``right`` with hot keys (at most 1/fraction keys, hence a proven bound) are broadcast to the rows of
    ``left`` that have them; all others, or all where no key is hot, take the ordinary shuffled join.  No row is
    dropped; NULL keys match nothing.  ``hot`` gives the hot keys where they are known.
    """
    hot = hot_values(left, key, fraction) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    many = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key)
    return many.unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


def spread_rank(
    rows: DataFrame, group: list[str], order: list[str], total_rows: int, weight: str | None = None,
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """``rank`` (from 1) within ``group`` by a uniformly distributed BIGINT ``order[0]``, ties by the rest.

    ``row_number`` over a group that holds a third of all rows would pull it into one task.  The range of
    the hash is cut into buckets; counts per (group, bucket) are prefix-summed on a table of bounded size
    and added to the rank within the bucket.  With ``weight`` also ``before``: its sum over earlier rows.
    """
    n_buckets = max(1, math.ceil(total_rows / rows_per_bucket))
    bucket = (F.shiftrightunsigned(F.col(order[0]), 1).cast("double") / F.lit(float(2**63)) * n_buckets).cast("int")
    tagged = rows.withColumn("_bucket", bucket)
    w = F.col(weight) if weight else F.lit(0)
    per = tagged.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(
        *group, "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
    )
    # NULL-safe: a NULL group value is a group too
    cond = [tagged[g].eqNullSafe(offsets[g]) for g in group] + [tagged["_bucket"] == offsets["_bucket"]]
    both = tagged.join(offsets, cond).select(tagged["*"], offsets["_n0"], offsets["_w0"])
    inside = W.partitionBy(*group, "_bucket").orderBy(*order)
    out = both.withColumn("rank", F.col("_n0") + F.row_number().over(inside))
    if weight:
        running = F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn("before", F.col("_w0") + F.coalesce(running, F.lit(0)))
    return out.drop("_bucket", "_n0", "_w0")


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` (from 1) of every row in a total order, without a window over the whole table.

    The rows are range-partitioned by the order and stored with the number of their partition; ranks within a partition
    are moved up by the counts of the partitions before it, of which there is one row each.
    """
    cut = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    cut = materialize(cut, "ranked")
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order)
    out = cut.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(before), "_part")
    return out.withColumn("rank", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
