"""Hot keys, spread ranks, components and nested records, on edge cases and against brute force."""

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kgspark.operators import nested, skew
from kgspark.operators.components import connected_components


def test_weighted_profile_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([1, 2, 2, 3, None])) for _ in range(3000)] + [(None, 5), ("solo", None), ("tie", 2), ("tie", 1)]
    got = {r["k"]: r for r in skew.weighted_profile(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", (0.5,)).collect()}
    per = defaultdict(list)
    for k, v in rows:
        per[k].append(v)
    for k, vs in per.items():
        real = [v for v in vs if v is not None]
        c = Counter(real)
        mode = min(c.items(), key=lambda x: (-x[1], x[0])) if c else (None, None)
        r = got[k]
        assert (r["n"], r["distinct_values"], r["mode_value"], r["mode_count"]) == (len(vs), len(c), *mode)
        if real:
            s = sorted(real)
            assert r["percentiles"][0] == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    assert skew.weighted_profile(spark.createDataFrame([], "k string, v int"), ["k"], "v").count() == 0


def test_hot_split_join_keeps_all_rows(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 300}", i) for i in range(600)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", "v") for i in range(200)], "k string, v string")
    plain, split = left.join(right, "k"), skew.hot_split_join(left, right, "k")
    assert sorted(map(tuple, split.select("k", "i", "v").collect())) == sorted(map(tuple, plain.select("k", "i", "v").collect()))
    assert skew.hot_split_join(left.limit(0), right, "k").count() == 0


def test_spread_rank_is_a_dense_rank_with_prefix_sums(spark):
    rows = [("big", i, i % 7) for i in range(5000)] + [("small", i, 3) for i in range(4)] + [(None, 1, 2)]
    df = spark.createDataFrame(rows, "g string, i int, w int").withColumn("h", F.xxhash64("i"))
    got = skew.spread_rank(df, ["g"], ["h", "i"], len(rows), weight="w", rows_per_bucket=100).collect()
    per = defaultdict(list)
    for r in got:
        per[r["g"]].append((r["rank"], r["before"], r["w"]))
    assert {g: len(v) for g, v in per.items()} == {"big": 5000, "small": 4, None: 1}
    for v in per.values():
        total = 0
        for k, (rank, before, w) in enumerate(sorted(v), 1):
            assert rank == k and before == total
            total += w


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3), (5, 5), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def brute_items(line_no, raw):
    """Flat items of one line, written without the operator."""
    seats = lambda x: [(0, x)] if isinstance(x, dict) else [(i, v) for i, v in enumerate(x) if isinstance(v, dict)] if isinstance(x, list) else []
    try:
        x = json.loads(raw.lstrip("﻿").strip()) if raw else None
    except ValueError:
        return
    if not isinstance(x, dict):
        return
    x = x.get("record") if isinstance(x.get("record"), dict) else x
    run = x.get("run") if isinstance(x.get("run"), dict) else {}
    for a_pos, a in seats(run["attempts"]) if "attempts" in run else [(0, x)]:
        res = a.get("result", a)
        if isinstance(res, str):
            try:
                res = json.loads(res)
            except ValueError:
                res = {}
        res = res if isinstance(res, dict) else {}
        text = lambda o, k: "" if o.get(k) is None else o[k]
        for i, e in seats(res.get("entities")):
            yield (line_no, a_pos, "entity", i, -1, text(e, "text"))
            for j, s in seats(e.get("spans")):
                yield (line_no, a_pos, "span", i, j, text(s, "surface"))
        for i, r in seats(res.get("relations")):
            yield (line_no, a_pos, "relation", i, -1, text(r, "subject"))


RAW = [
    None, "", "   ", "{", '{"a": 1', "[1, 2]", "7", '"text"', "null",
    '{"chunk_id": "c", "entities": [{"text": "A", "type": "T"}, null, {"type": "T"}], "relations": {"subject": "S"}}',
    '﻿{"chunk_id": "c", "run": {"attempts": [null, {"n": 1}, {"n": 2, "result": "{\\"entities\\": {\\"text\\": \\"B\\", \\"spans\\": [null, {\\"surface\\": null}]}}"}]}}',
    '{"record": {"chunk_id": "d", "run": {"attempts": {"result": {"entities": [], "relations": [{"subject": "q\\u00e9 \\"x\\""}]}}}}, "v": 2}',
    '{"chunk_id": "d", "run": {"attempts": [{"result": "not json"}, {"result": null}, {"result": {"entities": "odd"}}]}}',
    '{"chunk_id": "c", "entities": [{"text": "A", "type": "T"}, null, {"type": "T"}], "relations": {"subject": "S"}}',
    '{"chunk_id": "d"} trailing',
]


def test_nested_items_against_brute_force(spark, data):
    rows = list(enumerate(RAW)) + [(None, RAW[9])]
    df = spark.createDataFrame(rows, "line_no bigint, raw string").withColumn("kind", F.lit("clash")).withColumn("hash", F.lit(1))
    t = nested.merkle_tables(df)
    want = {x for i, r in enumerate(RAW) for x in brute_items(i, r)}
    assert {tuple(r) for r in nested.found_items(t).collect()} == want
    # equal records share one identity
    roots = {r["line_no"]: r["record_hash"] for r in t["lines"].collect()}
    assert roots[9] == roots[13] and len(set(roots.values())) == len(roots) - 1
    real = spark.read.parquet(f"{data}/extraction_runs.parquet").select("line_no", "raw")
    want = {x for r in real.collect() for x in brute_items(r["line_no"], r["raw"])}
    assert {tuple(r) for r in nested.found_items(nested.merkle_tables(real)).collect()} == want


def test_nested_parents_and_empty_table(spark):
    t = nested.merkle_tables(spark.createDataFrame([], "line_no bigint, raw string"))
    flat = nested.flat_tables(t)
    assert all(df.count() == 0 for df in [*t.values(), *flat.values()])
    t = nested.merkle_tables(spark.createDataFrame([(1, RAW[10])], "line_no bigint, raw string"))
    flat = nested.flat_tables(t)
    span, ent = flat["spans"].first(), flat["entities"].first()
    assert (span["chunk_id"], span["attempt_pos"], span["item_pos"], span["sub_pos"], span["entity_hash"]) == ("c", 2, 0, 1, ent["entity_hash"])
    assert flat["attempts"].count() == 2


def test_deep_and_long_lines(spark):
    deep = '{"chunk_id": "c", "x": ' + "[" * 5000 + "]" * 5000 + ', "entities": [{"text": "ok"}]}'
    long = json.dumps({"chunk_id": "c", "entities": [{"text": "w" * 300_000}] * 20})
    t = nested.merkle_tables(spark.createDataFrame([(1, deep), (2, long)], "line_no bigint, raw string"))
    got = nested.found_items(t).where("line_no = 2").collect()
    assert len(got) == 20 and len(got[0]["item_text"]) == 300_000 and t["objects"].where("kind = 'entity'").count() <= 2


def test_a_record_that_is_a_third_of_all_lines(spark):
    hot = '{"chunk_id": "h", "attempts": [{"n": 1, "result": {"entities": [{"text": "a", "spans": [{"surface": "s"}]}, {"text": "b"}]}}]}'
    rows = [(i, hot) for i in range(1000)] + [(1000 + i, hot.replace('"a"', f'"x{i}"')) for i in range(2000)]
    t = nested.merkle_tables(spark.createDataFrame(rows, "line_no bigint, raw string"))
    flat = nested.flat_tables(t)
    assert {k: v.count() for k, v in flat.items()} == {"attempts": 3000, "entities": 6000, "relations": 0, "spans": 3000}
    assert flat["entities"].where("text = 'b'").select("line_no").distinct().count() == 3000
    assert t["objects"].where("kind = 'entity'").count() == 2002 and t["bridge"].where("kind = 'span'").count() == 2001


def test_a_result_keeps_its_own_fields(spark):
    t = nested.merkle_tables(spark.createDataFrame([(1, '{"attempts": [{"status": "ok", "result": {"status": "other", "entities": []}}]}')], "line_no bigint, raw string"))
    assert nested.flat_tables(t)["attempts"].first()["status"] == "ok"


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 101).alias("k"), "id").repartition(7)
    got = [r["id"] for r in skew.global_rank(df, [F.desc("k"), F.col("id")]).orderBy("rank").collect()]
    assert got == [r["id"] for r in df.orderBy(F.desc("k"), "id").collect()]
    assert sorted(r["rank"] for r in skew.global_rank(df, [F.col("id")]).collect()) == list(range(1, 5001))
    assert skew.global_rank(df.limit(0), [F.col("id")]).count() == 0
