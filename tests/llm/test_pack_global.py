"""Scores of packed texts are those of BM25 over all documents, whatever the shard."""

import math
import random
from collections import Counter

from kgspark.llm import packing, tokens


def test_scores_do_not_depend_on_the_shard(spark):
    rng = random.Random(8)
    vocab = ["harbour", "seal", "clerk", "log", "tide", "beacon", "fee", "permit", "keeper", "archive", "claim", "relic", "cable", "water"]
    docs = [(i, " ".join(rng.choices(vocab[: 4 + i % 11], k=rng.randint(3, 40)))) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    packed = packing.pack_containers(df, "doc_id", "text", capacity=100, shard_docs=60).where("n_tokens > 0").collect()
    assert len({r["container_id"] // packing._CONTAINERS_PER_SHARD for r in packed}) > 2
    items = {i: tokens.encode(t).tolist() for i, t in docs}
    n, mean = len(items), sum(map(len, items.values())) / len(items)
    count = Counter(t for x in items.values() for t in set(x))

    def score(q, d):
        tf = Counter(items[d])
        idf = lambda t: max(0.0, math.log((n - count[t] + 0.5) / (count[t] + 0.5)))
        return sum(idf(t) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(items[d]) / mean)) for t in set(items[q]) if tf[t])

    seeds = {r["container_id"]: r["doc_id"] for r in packed if r["position"] == 0}
    others = [r for r in packed if r["position"] > 0]
    assert len(others) > 60
    assert all(abs(r["score"] - score(seeds[r["container_id"]], r["doc_id"])) < 1e-9 for r in others)


def test_routing_keeps_neighbours_together(spark):
    rng = random.Random(4)
    topics = [[f"{w}{k}" for w in ("harbour", "seal", "clerk", "tide", "fee", "relic", "cable", "water", "log", "claim")] for k in "abcdefghij"]
    docs = [(i, " ".join(rng.choices(topics[i % 10], k=30))) for i in range(600)]
    packed = packing.pack_containers(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", capacity=400, shard_docs=60).collect()
    shard = {r["doc_id"]: r["container_id"] // packing._CONTAINERS_PER_SHARD for r in packed}
    items = [tokens.encode(t) for _, t in docs]
    routed = packing.neighbour_share(items, [shard[i] for i, _ in docs])
    assert routed > 0.5 > 3 * packing.neighbour_share(items, rng.sample([shard[i] for i, _ in docs], len(docs)))


def test_copies_fill_many_shards(spark):
    """One text 5,000 times, without an id: every shard keeps to its size within chance."""
    rows = [(None, "the clerk seals the box of the northern tide and signs the log")] * 5000 + [(i, f"text {i} of another kind") for i in range(300)]
    packed = packing.pack_containers(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", shard_docs=256)
    got = Counter(r["container_id"] // packing._CONTAINERS_PER_SHARD for r in packed.collect())
    assert sum(got.values()) == 5300 and max(got.values()) < 2 * 256 and len(got) > 15


def test_shard_table():
    assert packing.shard_table([(0, 3), (1, 4), (2, 20), (3, 1), (4, 9)], 8) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 5, 2)]
    assert packing.shard_table([], 8) == []
