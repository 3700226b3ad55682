"""Every registered query runs on the smallest tables; those with an oracle agree with it."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from kgspark.operators import rag
from kgspark.plans import problems, reference  # noqa: E402

QUERIES = problems.QUERIES | reference.QUERIES
ORACLES = problems.ORACLES | reference.ORACLES


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, con, name):
    oracle.compare(QUERIES[name](spark, data), con, ORACLES[name])


def chunk_texts(spark, data):
    return spark.read.parquet(f"{data}/chunks.parquet").where("text is not null")


def test_chunk_unit(spark, data):
    """Every unit keeps its words in order; only what is in front of a first sub-paragraph may be left out."""
    texts = {r["seq"]: r["text"] for r in chunk_texts(spark, data).collect()}
    got = {}
    for r in QUERIES["chunk_unit"](spark, data).orderBy("seq", "part").collect():
        got.setdefault(r["seq"], []).append(r["text"])
    assert set(got) == set(texts)
    for seq, parts in got.items():
        words = texts[seq].split()
        assert " ".join(parts).split() == words[len(words) - sum(len(p.split()) for p in parts) :]
        assert len(parts) == 1 or len(texts[seq]) > 2000
        assert all(len(p) <= 2000 or not re.search(r"[.;]\s+[A-Z(]", p) for p in parts)


def test_chunk_documents(spark, data):
    rows = QUERIES["chunk_documents"](spark, data)
    docs = {f"D{r['doc_id']}" for r in spark.read.parquet(f"{data}/documents.parquet").where("trim(text) <> ''").collect()}
    assert {r["celex"] for r in rows.select("celex").distinct().collect()} == docs
    assert {r["chunk_type"] for r in rows.select("chunk_type").distinct().collect()} == {"recital", "article"}
    assert rows.where("chunk_id <> concat_ws('_', celex, chunk_type, unit_number, part)").count() == 0


def test_extract_rules(spark, data):
    rows = QUERIES["extract_rules"](spark, data)
    assert rows.count() == spark.read.parquet(f"{data}/chunks.parquet").select("chunk_id").distinct().count()
    assert rows.where("status <> 'ok' or size(filter(entities, e -> e.text is null)) > 0").count() == 0
    acts = rows.select(F.explode("entities").alias("e")).where("e.type = 'LEGAL_ACT'")
    assert acts.count() > 5 and acts.where(r"not rlike(e.text, '^(Regulation|Directive|Decision) ?\\((EU|EC)\\)')").count() == 0


def test_answers(spark, data):
    got = {r["question_id"]: r for r in QUERIES["answers"](spark, data).collect()}
    assert set(got) == {1, 2, 3} and got[3]["answer"] == rag.NO_MATCH and got[3]["context"] == ""
    assert [x["key"] for x in got[1]["entities"]][:1] == ["harbour data office"] and got[1]["context"].startswith("### ")
    for r in (got[1], got[2]):
        assert r["answer"] == rag.NO_PASSAGE or all(line[2:].rsplit(" [", 1)[0] in r["context"] for line in r["answer"].split("\n"))


def test_report_lines(spark, data):
    lines = [r["line"] for r in QUERIES["report_lines"](spark, data).orderBy("i").collect()]
    types = spark.read.parquet(f"{data}/entities_review.parquet").selectExpr("coalesce(entity_type, '') t").distinct().count()
    assert sum(": " in x and "/" in x and "=" in x for x in lines) == types and lines[0].startswith("# ")


def test_merkle_tables(spark, data):
    bridge, objects = QUERIES["p4_bridge"](spark, data), QUERIES["p4_objects"](spark, data)
    assert objects.count() == objects.select("hash").distinct().count() > 0
    ends = bridge.select(F.col("parent").alias("hash")).unionByName(bridge.select("hash"))
    assert ends.join(objects, "hash", "left_anti").count() == 0
    attempts = QUERIES["p4_attempts"](spark, data).count()
    assert objects.where("kind = 'attempt'").selectExpr("sum(occurrences) n").first()["n"] == attempts


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLES) == {"chunk_unit", "chunk_documents", "extract_rules", "answers", "report_lines", "p4_bridge", "p4_objects"}


def test_entry(spark, data):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and [r["rank"] for r in rows] == list(range(1, 21))
    assert set(entry.oracle_sql()) <= set(entry.queries())
