"""Extraction runner: statuses, timeouts, fallback; files and the resuming stream."""

import json
import os
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from kgspark.operators import extract
from kgspark.sources import files
from kgspark.streaming.resume import resume_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fake:
    name = "fake"

    def load(self):
        pass

    def extract(self, text):
        if text == "boom":
            raise ValueError("bad text")
        if text == "slow":
            time.sleep(30)
        return {"entities": [{"text": text, "type": "DATE"}, {"text": "x", "type": "NOPE"}], "relations": [{"subject": "a", "relation": "R", "object": "b"}]}


class Second(Fake):
    name = "second"

    def extract(self, text):
        return {"entities": [{"text": "A", "type": "DATE"}, {"text": "B", "type": "DATE"}], "relations": [{"subject": "a ", "relation": "AMENDS", "object": "b"}, {"subject": "a", "relation": "AMENDS", "object": "c"}]}


def chunks(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")


def test_statuses_without_timeout(spark):
    got = {r["chunk_id"]: r for r in extract.run(chunks(spark, "ok", "boom", None, ""), Fake()).collect()}
    assert got["0"]["status"] == "ok" and [e["text"] for e in got["0"]["entities"]] == ["ok"] and got["0"]["relations"] == []
    assert got["1"]["status"] == "error" and "bad text" in got["1"]["error"]
    assert got["2"]["status"] == "ok" and got["2"]["entities"] == [] and got["3"]["entities"] == []


class Counting(Fake):
    """Counts its loads in a file, and ends its process on one word."""

    name = "counting"

    def __init__(self, path):
        self.path = path

    def load(self):
        with open(self.path, "a") as f:
            f.write("x")

    def extract(self, text):
        if text == "die":
            os._exit(3)
        return super().extract(text)


def test_leash_ends_slow_calls_and_goes_on(tmp_path):
    log = tmp_path / "loads"
    safe = extract.Leash(Counting(str(log)), limit=1.0)
    try:
        assert safe.ask("slow") == ("timeout", "no answer within 1.0 s, 2 times", 2)
        assert safe.ask("fine")[0] == "ok" and safe.ask("boom")[:2] == ("error", "bad text")
        assert log.read_text() == "xxx"  # two that were ended, one that still lives
        assert safe.ask("die") == ("timeout", "the process ended, 2 times", 2)
    finally:
        safe.drop()


def test_timeout_in_a_run_becomes_a_row(spark):
    got = {r["chunk_id"]: r for r in extract.run(chunks(spark, "ok", "slow", None).coalesce(1), Fake(), timeout=1.5).collect()}
    assert got["0"]["status"] == "ok" and got["1"]["status"] == "timeout" and got["1"]["attempts"] == 2 and got["2"]["entities"] == []


def test_backend_is_loaded_once_per_process(tmp_path):
    b = Counting(str(tmp_path / "loads"))
    assert extract.loaded(b) is extract.loaded(Counting("elsewhere")) and (tmp_path / "loads").read_text() == "x"


def test_fallback_and_grounding(spark):
    out = extract.run_with_fallback(chunks(spark, "ok", "boom"), Fake(), Second())
    got = {r["chunk_id"]: r for r in out["results"].collect()}
    assert got["0"]["backend"] == "fake" and got["1"]["backend"] == "second"
    assert [(r["subject"], r["object"]) for r in got["1"]["relations"]] == [("a ", "b")]
    assert out["failures"].count() == 0


def test_pending(spark):
    done = spark.createDataFrame([("0",), (None,)], "chunk_id string")
    assert [r["chunk_id"] for r in extract.pending(chunks(spark, "a", "b"), done).collect()] == ["1"]


def test_rules_find_acts_dates_and_relations():
    b = extract.RuleBackend()
    out = b.extract("Regulation (EU) 2031/108 repeals Directive (EU) 2030/7 on 3 May 2031.")
    assert [e["type"] for e in out["entities"]] == ["LEGAL_ACT", "LEGAL_ACT", "DATE"]
    assert out["relations"][0]["relation"] == "REPEALS"
    assert b.extract("") == {"entities": [], "relations": []}


def test_file_round_trips(spark, tmp_path):
    doc = {"celex": "A", "title": "T", "date": "", "recitals": ["r"], "articles": [{"number": 1, "heading": "h", "text": "x"}], "full_text": "f"}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps(doc, indent=1))
    assert files.read_documents(spark, str(tmp_path / "docs")).first()["articles"][0]["heading"] == "h"
    (tmp_path / "x_chunks.json").write_text(json.dumps([{"chunk_id": "1", "text": "a"}, {"chunk_id": "2", "heading": None}], indent=1))
    assert files.read_chunk_arrays(spark, str(tmp_path / "x_chunks.json")).count() == 2
    (tmp_path / "e.jsonl").write_text('{"chunk_id": "1", "entities": [{"text": "t", "type": "DATE"}], "relations": []}\n\n{"chunk_id": "2"}\n')
    got = files.read_json_lines(spark, str(tmp_path / "e.jsonl")).orderBy("seq").collect()
    assert [r["chunk_id"] for r in got] == ["1", "2"] and got[0]["entities"][0]["text"] == "t"
    rev = spark.createDataFrame([("c", 'say "hi"\nthere', "t", "DATE", "Y", "", "")], "chunk_id string, chunk_text string, entity_text string, entity_type string, is_correct string, corrected_type string, notes string")
    files.write_review(rev, str(tmp_path / "rev"))
    assert files.read_review(spark, str(tmp_path / "rev")).first()["chunk_text"] == 'say "hi"\nthere'
    files.write_partitioned(spark.createDataFrame([("A", 1), ("B", 2)], "celex string, n int"), str(tmp_path / "part"))
    assert spark.read.parquet(str(tmp_path / "part")).where("celex = 'A'").count() == 1
    t = str(tmp_path / "swap")
    spark.range(3).write.parquet(t)
    files.swap(spark, spark.read.parquet(t).withColumn("id", F.col("id") + 1), t)
    assert sorted(r["id"] for r in spark.read.parquet(t).collect()) == [1, 2, 3]
    files.append_results(spark.range(2), str(tmp_path / "app"))
    files.append_results(spark.range(2), str(tmp_path / "app"))
    assert spark.read.parquet(str(tmp_path / "app")).count() == 4
    files.log_metrics(spark.createDataFrame([("m", 1.0)], "metric string, value double"), "r1", str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).first()["run_id"] == "r1"


def test_pages_and_sidecars(spark, tmp_path):
    (tmp_path / "raw" / "A").mkdir(parents=True)
    (tmp_path / "raw" / "A" / "document.pdf").write_bytes(b"one\x0ctwo")
    got = files.read_pages(spark, str(tmp_path / "raw"), lambda b: b.decode().split("\x0c")).orderBy("page").collect()
    assert [(r["celex"], r["page"], r["text"]) for r in got] == [("A", 0, "one"), ("A", 1, "two")]
    reg = spark.createDataFrame([("A", "a"), ("B", "b")], "celex string, title string")
    assert [r["celex"] for r in files.missing_sidecars(reg, reg.where("celex = 'A'")).collect()] == ["B"]
    assert {tuple(r) for r in files.registry_status(reg, reg.where("celex = 'A'")).collect()} == {("A", True), ("B", False)}


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, bad, state = (str(tmp_path / d) for d in ("src", "out", "bad", "state"))
    chunks(spark, "Regulation (EU) 2031/108", "plain").write.json(src)
    resume_stream(spark, src, out, bad, state)
    resume_stream(spark, src, out, bad, state)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("9", "Directive (EU) 2031/9")], "chunk_id string, text string").write.mode("append").json(src)
    resume_stream(spark, src, out, bad, state)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(out).collect()) == ["0", "1", "9"]
    chunks(spark, "changed", "again").write.mode("append").json(src)  # the ids 0 and 1 once more, in a new file
    resume_stream(spark, src, out, bad, state)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(out).collect()) == ["0", "1", "9"]
