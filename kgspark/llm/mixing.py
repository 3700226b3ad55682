"""Mixing sources to target weights with a hypergeometric splitting tree.

Sizes are counted once.  For every source the plan fixes how many whole passes over its documents and how
many tokens of one further pass are taken.  Documents are put in random order by hash rank and cut into
blocks.  A binary tree over the output shards splits the exact block counts of all sources: the left half of
a node draws its blocks by a multivariate hypergeometric law, the right half keeps the rest, so quotas add
up exactly at every level.  The blocks of a source are permuted and handed to the shards by those quotas
without overlap, and each shard is shuffled locally.

Defined results: documents without source or with a source that has no target are not used (they count in
the total size); NULL and empty texts have size 0; a source without documents is reported short.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.tokens import DEFAULT_VOCABULARY, token_count
from kgspark.operators.skew import spread_rank
from kgspark.session import materialize, spread

BLOCK_TOKENS = 32_768
SHARD_TOKENS = 2_000_000
#: Shards whose part of the tree is expanded on the driver; below that the subtrees are expanded by tasks.
DRIVER_LEAVES = 1024
MAX_SOURCES = 10_000


def split_node(counts: np.ndarray, lo: int, hi: int, leaves: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """Nodes (lo, hi, counts) after splitting [lo, hi) until a node has at most ``leaves`` shards."""
    if hi - lo <= leaves:
        return [(lo, hi, counts)]
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    total = int(counts.sum())
    left = rng.multivariate_hypergeometric(counts, total * (mid - lo) // (hi - lo), method="marginals") if total else counts
    return split_node(left, lo, mid, leaves, seed) + split_node(counts - left, mid, hi, leaves, seed)


def shard_quotas(spark, names: list[str], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(source, shard, n): blocks of each source that a shard receives."""
    top = split_node(np.array(blocks, dtype=np.int64), 0, shards, max(1, math.ceil(shards / DRIVER_LEAVES)), seed)
    nodes = spark.createDataFrame([(lo, hi, [int(c) for c in counts]) for lo, hi, counts in top], "lo int, hi int, counts array<bigint>")
    if shards > DRIVER_LEAVES:
        nodes = nodes.repartition(min(len(top), 256), "lo")

    def expand(batches):
        for pdf in batches:
            rows = []
            for lo, hi, counts in zip(pdf["lo"], pdf["hi"], pdf["counts"], strict=True):
                for a, _, c in split_node(np.array(counts, dtype=np.int64), lo, hi, 1, seed):
                    rows += [(names[i], a, int(n)) for i, n in enumerate(c)]
            yield pd.DataFrame(rows, columns=["source", "shard", "n"])

    return nodes.mapInPandas(expand, "source string, shard int, n bigint")


def mix_sources(
    docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 42,
    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS,
) -> dict[str, DataFrame]:
    """``mix`` (shard, shuffle_key, source, doc_id, copy, n_tokens) and ``report`` (one row per source)."""
    spark = docs.sparkSession
    sizes = spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", token_count(vocabulary)("text").alias("n_tokens"))
    sizes = materialize(sizes, "mix-sizes")
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    rows = targets.where("source is not null").join(per, "source", "left").select("source", "target_permille", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens")).distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = []
    for r in sorted(rows, key=lambda r: r["source"]):
        want, size = r["target_permille"] * total // 1000, r["tokens"]
        take = min(want, r["max_repeats"] * size)
        full, rest = divmod(take, size) if size else (0, 0)
        per_pass = max(1, math.ceil(size / block_tokens))
        blocks = full * per_pass + math.ceil(rest / block_tokens)
        plan.append((r["source"], r["target_permille"], r["max_repeats"], r["docs"], size, want, take, full, rest, per_pass, blocks))
    schema = "source string, target_permille int, max_repeats int, docs bigint, tokens bigint, want bigint, take bigint, full bigint, rest bigint, per_pass bigint, blocks bigint"
    plan_df = spark.createDataFrame(plan, schema)  # one row per target, bounded by MAX_SOURCES
    used = sizes.join(F.broadcast(plan_df.select("source")), "source", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    ranked = spread_rank(used, ["source"], ["h", "doc_id"], sum(r[3] for r in plan), weight="n_tokens")
    got = ranked.join(F.broadcast(plan_df.select("source", "full", "rest", "per_pass", "blocks")), "source")
    copies = F.col("full") + F.when(F.col("before") + F.col("n_tokens") <= F.col("rest"), 1).otherwise(0)
    got = got.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    block = F.col("copy") * F.col("per_pass") + F.least(F.floor(F.col("before") / block_tokens), F.col("per_pass") - 1)
    got = materialize(got.withColumn("block", F.least(block, F.col("blocks") - 1)).select("source", "block", "doc_id", "copy", "n_tokens"), "mix-blocks")
    # a random permutation of the blocks of a source: the rank of their keyed hashes
    order = spread_rank(got.select("source", "block").distinct().withColumn("h", F.xxhash64("source", "block", F.lit(seed))), ["source"], ["h", "block"], sum(r[10] for r in plan))
    # a block is of bounded size, so this join has no hot key
    got = got.join(order.select("source", "block", (F.col("rank") - 1).alias("seat")), ["source", "block"])
    shards = max(1, math.ceil(sum(r[6] for r in plan) / shard_tokens))
    quotas = shard_quotas(spark, [r[0] for r in plan], [r[10] for r in plan], shards, seed)
    upto = F.sum("n").over(W.partitionBy("source").orderBy("shard"))
    seats = quotas.withColumn("upto", upto).where("n > 0").select("source", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("seat"))
    # a seat is one block of bounded size, so this join has no hot key
    mix = got.join(seats, ["source", "seat"]).select("shard", F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("shuffle_key"), "source", "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens")
    reached = mix.groupBy("source").agg(F.sum("n_tokens").alias("got_tokens"), F.count(F.lit(1)).alias("rows"), F.max(F.col("copy") + 1).alias("most_repeats"))
    report = plan_df.join(reached, "source", "left").select(
        "source", "target_permille", "max_repeats", "docs", "tokens", F.col("want").alias("want_tokens"),
        F.coalesce("got_tokens", F.lit(0)).alias("got_tokens"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce("got_tokens", F.lit(0)) * 1000 / F.lit(max(total, 1)), 3).alias("reached_permille"),
        # the mix holds every document of the source as often as it may, and that is not enough
        ((F.coalesce("rows", F.lit(0)) >= F.col("docs") * F.col("max_repeats")) & (F.coalesce("got_tokens", F.lit(0)) * 1000 < F.col("target_permille").cast("bigint") * F.lit(total).cast("bigint"))).alias("short"),
    )
    return {"mix": mix, "report": report}


def shuffled_shards(mix: DataFrame) -> DataFrame:
    """Rows grouped by shard and in the local shuffle's order, ready to be written."""
    return mix.repartition("shard").sortWithinPartitions("shard", "shuffle_key")
