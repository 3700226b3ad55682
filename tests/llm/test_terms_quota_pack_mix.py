"""Term frequencies, quota samples, packing and mixing against brute force."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import mixing, packing, quota, terms, tokens

PAIRS = "field_name string, field_value string, record string, row_id bigint"


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_terms_against_brute_force(spark, partitions):
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        term = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None, "ü", "z" * 50])
        rec = "R" if rng.random() < 0.5 else rng.choice(["r1", "r2", "", None, str(i)])
        rows.append((rng.choice("xy"), term, rec, i))
    df = spark.createDataFrame(rows, PAIRS).withColumn("part", F.lit(9)).withColumn("docs", F.lit("clash"))
    got = {(r["field_name"], r["field_value"]): (r["occurrences"], r["records"]) for r in terms.term_frequencies(df, partitions).collect()}
    occ, recs = Counter(), defaultdict(set)
    for f, t, r, _ in rows:
        if t:
            occ[(f, t)] += 1
            if r is not None:
                recs[(f, t)].add(r)
    assert got == {k: (n, len(recs[k])) for k, n in occ.items()}


def test_terms_empty_and_marks(spark):
    assert terms.term_frequencies(spark.createDataFrame([], PAIRS)).count() == 0
    f = spark.createDataFrame([("f", "once", 5, 1), ("f", "ten", 1, 10), ("f", "eleven", 1, 11), ("f", "none", 3, 0)], "field_name string, field_value string, occurrences bigint, records bigint")
    got = {r["field_value"]: r["mark"] for r in terms.mark_terms(f, 100).collect()}
    assert got == {"once": "rare", "ten": None, "eleven": "common", "none": None}


def brute_seats(available, targets, floors, size):
    rows = []
    for i, (n, t, f) in enumerate(zip(available, targets, floors, strict=True)):
        for r in range(1, n + 1):
            first = r <= min(n, f)
            if first or t > 0:
                rows.append((not first, Fraction(2 * r - 1, 2 * t) if t else Fraction(r), i))
    rows.sort()
    got = [0] * len(available)
    for _, _, i in rows[:size]:
        got[i] += 1
    return got


def test_seats_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        k = rng.randint(1, 5)
        args = [rng.randint(0, 60) for _ in range(k)], [rng.choice([1, 10, 100, 350]) for _ in range(k)], [rng.randint(0, 8) for _ in range(k)], rng.randint(0, 120)
        assert quota.seats(*args) == brute_seats(*args), args


TARGETS = "plan_id int, pool string, category string, target_permille int, sample_size int, min_rows int"


def test_quota_sample(spark):
    items = [("p", "big", f"i{n}") for n in range(900)] * 2 + [("p", "small", "only")] + [("p", None, "x"), (None, "big", "x"), ("p", "big", None), ("p", "other", "y")]
    df = spark.createDataFrame(items, "pool string, category string, item string").withColumn("rank", F.lit(1)).withColumn("available", F.lit("clash"))
    t = spark.createDataFrame([(1, "p", "big", 500, 100, 5), (1, "p", "small", 500, 100, 5), (1, "p", "gone", 0, 100, 0), (2, "p", "big", 1000, 10, 0), (None, "p", "big", 1, 1, 1), (3, "p", "big", None, None, None)], TARGETS)
    out = quota.quota_sample(df, t)
    got = Counter((r["plan_id"], r["category"]) for r in out["sample"].collect())
    assert got == {(1, "big"): 99, (1, "small"): 1, (2, "big"): 10}
    rep = {(r["plan_id"], r["category"]): r for r in out["report"].collect()}
    assert rep[(1, "small")]["short"] and not rep[(1, "big")]["short"] and not rep[(1, "gone")]["short"] and rep[(1, "big")]["available"] == 900
    assert sorted(map(tuple, out["sample"].collect())) == sorted(map(tuple, quota.quota_sample(df, t)["sample"].collect()))
    none = quota.quota_sample(df.limit(0), t)
    assert none["sample"].count() == 0 and none["report"].where("short").count() == 3
    assert quota.quota_sample(df, t.limit(0))["report"].count() == 0


def test_bm25_against_plain_formula():
    rng = random.Random(3)
    items = [np.array(rng.choices(range(40), k=rng.randint(0, 30)), dtype=np.int64) for _ in range(25)]
    index, n = packing.Bm25Index(items), len(items)
    avg = sum(map(len, items)) / n
    df = Counter(t for x in items for t in set(x.tolist()))
    for q in range(n):
        want = []
        for d in items:
            tf, s = Counter(d.tolist()), 0.0
            for t in set(items[q].tolist()):
                idf = max(0.0, np.log((n - df[t] + 0.5) / (df[t] + 0.5)))
                s += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg)) if tf[t] else 0.0
            want.append(s)
        assert np.allclose(index.scores(q), want)


def test_pack_uses_every_item_once():
    rng = random.Random(2)
    items = [np.array(rng.choices(range(500), k=rng.choice([0, 1, 50, 300, 1000])), dtype=np.int64) for _ in range(300)]
    boxes = packing.pack(items, 1000)
    used = [i for b in boxes for i, _ in b]
    assert sorted(used) == [i for i, x in enumerate(items) if len(x)]
    assert all(sum(len(items[i]) for i, _ in b) <= 1000 for b in boxes)
    assert len(boxes) <= 1.05 * -(-sum(map(len, items)) // 1000) + 1
    assert packing.pack([], 10) == []


def test_containers(spark):
    long = "The clerk seals the box and signs the log. " * 700
    rows = [(1, long), (2, "short text"), (2, "short text"), (None, "no id"), (3, None), (4, ""), (2**60 + 1, "large id")] + [(10 + i, "Words about harbours and seals. " * (i % 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("clash")).withColumn("score", F.lit(0))
    packed = packing.pack_containers(df, "doc_id", "text", shard_docs=64)
    got = packed.collect()
    sizes = Counter()
    for r in got:
        if r["container_id"] is not None:
            sizes[r["container_id"]] += r["n_tokens"]
    assert max(sizes.values()) <= 4096
    assert sum(r["n_tokens"] for r in got) == sum(len(tokens.encode(t)) for _, t in rows)
    n = len(tokens.encode(long))
    pieces = sorted((r["piece_no"], r["token_start"], r["n_tokens"]) for r in got if r["doc_id"] == 1)
    assert [p[1] for p in pieces] == [i * 4096 for i in range(len(pieces))] and sum(p[2] for p in pieces) == n and len(pieces) == -(-n // 4096)
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {1}
    assert sum(r["doc_id"] == 2 for r in got) == 2 and any(r["doc_id"] == 2**60 + 1 for r in got) and any(r["doc_id"] is None for r in got)
    assert packing.pack_containers(df.limit(0), "doc_id", "text").count() == 0
    assert packing.packing_report(packed).first()["largest"] <= 4096


def test_splitting_tree_is_exact():
    counts = np.array([1000, 37, 0, 5])
    leaves = mixing.split_node(counts, 0, 13, 1, seed=1)
    assert len(leaves) == 13 and (sum(c for _, _, c in leaves) == counts).all()
    assert max(c.sum() for _, _, c in leaves) - min(c.sum() for _, _, c in leaves) <= 4
    top = mixing.split_node(counts, 0, 13, 4, seed=1)
    again = [x for lo, hi, c in top for x in mixing.split_node(c, lo, hi, 1, seed=1)]
    assert [(a, b, c.tolist()) for a, b, c in again] == [(a, b, c.tolist()) for a, b, c in leaves]


def test_mix(spark):
    text = "one two three four five six seven eight nine ten. "
    rows = [(i, "a", text * (1 + i % 5)) for i in range(300)] + [(1000 + i, "b", text * 2) for i in range(60)] + [(2000 + i, "c", text) for i in range(20)]
    rows += [(3000, None, text), (3001, "untargeted", text), (3002, "a", None), (3003, "b", ""), (None, "a", text), (5, "a", text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("h", F.lit("clash")).withColumn("rank", F.lit(0))
    t = spark.createDataFrame([("a", 500, 1), ("b", 300, 3), ("c", 190, 2), ("empty", 10, 2)], "source string, target_permille int, max_repeats int")
    out = mixing.mix_sources(docs, t, block_tokens=200, shard_tokens=1500)
    total = sum(len(tokens.encode(x)) for _, _, x in rows)
    size = Counter()
    for _, s, x in rows:
        size[s] += len(tokens.encode(x))
    mix = out["mix"].collect()
    reps, got = Counter((r["source"], r["doc_id"], r["copy"]) for r in mix), Counter()
    for r in mix:
        got[r["source"]] += r["n_tokens"]
    assert max(v for k, v in reps.items() if k[1] not in (None, 5)) == 1
    rep = {r["source"]: r for r in out["report"].collect()}
    for s, permille, most in (("a", 500, 1), ("b", 300, 3), ("c", 190, 2), ("empty", 10, 2)):
        want = min(permille * total // 1000, most * size[s])
        assert want - 60 <= got[s] <= want
        assert rep[s]["got_tokens"] == got[s] and rep[s]["short"] == (most * size[s] * 1000 < permille * total)
    assert len({r["shard"] for r in mix}) > 3
    assert {r["source"] for r in mix} <= {"a", "b", "c"}
    ordered = mixing.shuffled_shards(out["mix"]).collect()
    seen = [r["shard"] for r in ordered]
    assert sum(a != b for a, b in zip(seen, seen[1:], strict=False)) < 2 * len(set(seen)) + 8
    empty = mixing.mix_sources(docs.limit(0), t)
    assert empty["mix"].count() == 0 and empty["report"].where("short").count() == 0


def test_mix_subtrees_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_LEAVES", 4)
    q = mixing.shard_quotas(spark, ["x", "y"], [500, 40], 37, seed=3).collect()
    per = Counter()
    for r in q:
        per[r["source"]] += r["n"]
    assert per == {"x": 500, "y": 40} and {r["shard"] for r in q} == set(range(37))
