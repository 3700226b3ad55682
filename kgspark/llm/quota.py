"""Samples that match target proportions, by divisor-method priorities.

Records of a category are ranked in random order; the record of rank r has priority (r - 0.5) / target, the
first ``min_rows`` of a category come before all others, and the globally smallest priorities are kept.  An
exhausted category has no further priorities, so its seats go to the others by themselves.  The k-th
smallest priority follows from the category counts alone, so nothing is sorted globally: the seats per
category are computed on the (fixed, small) target table and a record is kept if its rank is within them.

Defined results: NULL categories and items belong to no category; repeated items count once; a category
without items gets no seat and is reported short; an empty pool gives an empty sample; targets without plan,
pool or category are left out, missing numbers are 0, and a target of 0 gets its minimum only.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.skew import spread_rank
from kgspark.session import materialize

#: The target table is a parameter table; more rows than this are refused.
MAX_TARGETS = 100_000


def seats(available: list[int], targets: list[int], floors: list[int], size: int) -> list[int]:
    """Seats per category: floors first, then the smallest (rank - 0.5) / target, ties to the earlier category."""
    k = len(available)
    first = [min(a, f) for a, f in zip(available, floors, strict=True)]
    heap: list[tuple[Fraction, int, int]] = []

    def priority(i: int, rank: int) -> Fraction:
        return Fraction(2 * rank - 1, 2 * targets[i])

    def fill(start: list[int], limit: list[int], room: int) -> list[int]:
        """Adds the ``room`` smallest priorities above ``start`` and up to ``limit``."""
        got = list(start)
        open_ = [i for i in range(k) if limit[i] > got[i] and targets[i] > 0]
        room = min(room, sum(limit[i] - got[i] for i in open_))
        # jump close to the threshold, then finish seat by seat
        lo, hi = 0.0, float(max((2 * limit[i] for i in open_), default=0)) + 1
        for _ in range(100):
            mid = (lo + hi) / 2
            if sum(max(0, min(limit[i], int(mid * targets[i] + 0.5)) - got[i]) for i in open_) <= max(0, room - k):
                lo = mid
            else:
                hi = mid
        jump = [max(got[i], min(limit[i], int(lo * targets[i] + 0.5))) if i in open_ else got[i] for i in range(k)]
        room -= sum(jump) - sum(got)
        heap[:] = [(priority(i, jump[i] + 1), i, jump[i] + 1) for i in open_ if jump[i] < limit[i]]
        heapq.heapify(heap)
        while room > 0 and heap:
            _, i, rank = heapq.heappop(heap)
            jump[i], room = rank, room - 1
            if rank < limit[i]:
                heapq.heappush(heap, (priority(i, rank + 1), i, rank + 1))
        return jump

    if sum(first) >= size:
        return fill([0] * k, first, size)
    return fill(first, list(available), size - sum(first))


def quota_sample(items: DataFrame, targets: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """``sample`` (plan_id, pool, category, item, rank, priority) and ``report`` (one row per target).

    ``items`` has pool, category, item; ``targets`` has plan_id, pool, category, target_permille,
    sample_size, min_rows.
    """
    spark = items.sparkSession
    pool = items.select("pool", "category", "item").where("pool is not null and category is not null and item is not null")
    wanted = targets.select("pool", "category").distinct()
    if wanted.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    pool = materialize(pool.join(F.broadcast(wanted), ["pool", "category"], "left_semi").distinct(), "quota-items")
    counts = pool.groupBy("pool", "category").agg(F.count(F.lit(1)).alias("available"))
    rows = (
        targets.join(counts, ["pool", "category"], "left")
        .where("plan_id is not null and pool is not null and category is not null")
        .select("plan_id", "pool", "category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("target_permille", "sample_size", "min_rows", "available")])
        .distinct().limit(MAX_TARGETS + 1).collect()
    )
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    plan = []
    for key in sorted({(r["plan_id"], r["pool"]) for r in rows}):
        own = sorted((r for r in rows if (r["plan_id"], r["pool"]) == key), key=lambda r: r["category"])
        got = seats([r["available"] for r in own], [r["target_permille"] for r in own], [r["min_rows"] for r in own], max(r["sample_size"] for r in own))
        plan += [(*(r[c] for c in ("plan_id", "pool", "category", "target_permille", "sample_size", "min_rows", "available")), g) for r, g in zip(own, got, strict=True)]
    schema = "plan_id int, pool string, category string, target_permille int, sample_size int, min_rows int, available bigint, seats bigint"
    plan_df = spark.createDataFrame(plan, schema)
    total = sum({(p[1], p[2]): p[6] for p in plan}.values())
    ranked = spread_rank(pool.withColumn("h", F.xxhash64("item", "category", F.lit(seed))), ["pool", "category"], ["h", "item"], total)
    need = F.greatest(F.col("min_rows").cast("bigint"), F.expr("(bigint(target_permille) * sample_size + 999) div 1000"))
    plan_df = plan_df.withColumn("needed", need)
    # one row per target: bounded by MAX_TARGETS, so the broadcast is too
    drawn = ranked.join(F.broadcast(plan_df.select("plan_id", "pool", "category", "target_permille", "seats", "needed")), ["pool", "category"])
    sample = drawn.where("rank <= seats")
    sample = sample.select("plan_id", "pool", "category", "item", "rank", F.try_divide(F.col("rank") - 0.5, F.col("target_permille").cast("double")).alias("priority"))
    # what the draw gave each target, and what it would give if the target had all the seats it needs
    got = drawn.groupBy("plan_id", "pool", "category").agg(F.count_if(F.col("rank") <= F.col("seats")).alias("drawn"), F.count_if(F.col("rank") <= F.col("needed")).alias("reachable"))
    report = plan_df.join(got, ["plan_id", "pool", "category"], "left")
    report = report.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("drawn", "reachable")}).withColumn("short", F.col("reachable") < F.col("needed"))
    return {"sample": sample, "report": report}
