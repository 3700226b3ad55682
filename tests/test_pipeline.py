"""The pipeline end to end on two small acts, and the reviewing backend."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from kgspark.operators import evaluate, rag, review
from kgspark.plans import pipeline
from kgspark.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ACT = (
    "EN\nREGULATION (EU) 2031/{n} OF THE COUNCIL\nof 3 May 2031\non harbours\n(Text with EEA relevance)\nWhereas: (1) The Harbour Data Office shall inform the "
    "Joint Registry Board. HAVE ADOPTED THIS REGULATION:\nArticle 1\nScope\nRegulation (EU) 2031/{n} repeals Directive (EU) 2030/7.\nDone at Rome, 3 May 2031"
)


class Failing:
    name = "failing"

    def load(self):
        pass

    def extract(self, text):
        raise RuntimeError("no model")


def test_end_to_end(spark, tmp_path):
    base = str(tmp_path)
    for c, n in (("A1", 1), ("B2", 2)):
        (tmp_path / "raw" / c).mkdir(parents=True)
        (tmp_path / "raw" / c / "document.pdf").write_bytes(ACT.format(n=n).encode())
    reg = spark.createDataFrame([("A1", "Act one"), ("B2", "Act two")], "celex string, title string")
    docs = pipeline.ingest_pages(spark, base, reg, lambda b: [b.decode()])
    assert {r["title"] for r in docs.collect()} == {"REGULATION (EU) 2031/1 OF THE COUNCIL on harbours", "REGULATION (EU) 2031/2 OF THE COUNCIL on harbours"}
    assert pipeline.chunk_all(spark, base).count() == 4
    assert pipeline.extract_pending(spark, base, Failing()).count() == 0
    assert spark.read.parquet(f"{base}/failures").count() == 4
    assert pipeline.extract_pending(spark, base, retry_failed=True).count() == 4
    assert pipeline.extract_pending(spark, base).count() == 4  # nothing left to do
    g = pipeline.load_graph(spark, base, reg)
    assert g["documents"].count() == 2 and g["chunks"].count() == 4
    edges = {tuple(r) for r in g["relations"].collect()}
    assert ("regulation (eu) 2031/1", "REPEALS", "directive (eu) 2030/7") in edges
    pipeline.load_graph(spark, base, reg)
    rows = pipeline.labelling_files(spark, base)
    assert rows["entities"].count() > 0
    ent = files.read_review(spark, f"{base}/labeled/entities_review").withColumn("is_correct", F.lit("Y"))
    rel = files.read_review(spark, f"{base}/labeled/relations_review", relations=True).withColumn("is_correct", F.lit("N"))
    text = pipeline.log_run(spark, base, "r1", ent, rel)
    assert "100.0%" in text and all(x in text for x in evaluate.KNOWN_PATTERNS) and evaluate.RELATION_NOTE in text
    assert files.read_review(spark, f"{base}/artifacts/r1/entities_review").count() == ent.count()
    assert spark.read.parquet(f"{base}/eval_runs").where("metric = 'relation_precision'").first()["value"] == 0.0


def prepared(spark, tmp_path):
    base = str(tmp_path)
    for c, n in (("B2", 2), ("A1", 1)):
        (tmp_path / "raw" / c).mkdir(parents=True)
        (tmp_path / "raw" / c / "document.pdf").write_bytes(ACT.format(n=n).encode())
    pipeline.ingest_pages(spark, base, spark.createDataFrame([("A1", "Act one")], "celex string, title string"), lambda b: [b.decode()])
    pipeline.chunk_all(spark, base)
    return base


def test_chunks_are_numbered_by_arrival(spark, tmp_path):
    base = prepared(spark, tmp_path)
    rows = spark.read.parquet(f"{base}/chunks").orderBy("seq").collect()
    assert [r["chunk_id"] for r in rows] == ["A1_recital_1_0", "A1_article_1_0", "B2_recital_1_0", "B2_article_1_0"]
    assert len({r["seq"] for r in rows}) == 4


def test_sample_extraction(spark, tmp_path):
    base = prepared(spark, tmp_path)
    got = pipeline.extract_sample(spark, base, per_document=1, least_chars=20)
    assert got["records"].count() == 2 and {r["kind"] for r in got["counts"].collect()} <= {"entity", "relation"}
    back = files.read_chunk_arrays(spark, f"{base}/extraction_sample/celex=A1")
    assert back.count() == 1 and back.first()["chunk_id"].startswith("A1_")


def test_review_steps_rewrite_the_stored_tables(spark, tmp_path):
    base = prepared(spark, tmp_path)
    pipeline.extract_pending(spark, base)
    pipeline.labelling_files(spark, base)
    n = files.read_review(spark, f"{base}/labeled/entities_review").count()
    wait = review.Patience(attempts=1, busy_wait=0, step_wait=0)
    check = pipeline.pre_review_step(spark, base, "entities", Picky(), wait)
    rows = files.read_review(spark, f"{base}/labeled/entities_review")
    assert n > 0 and rows.count() == n and not review.unlabelled(rows).count() and check.count() == n
    one = rows.limit(1).select("chunk_id", "entity_text", "entity_type", F.lit("Y").alias("is_correct"), F.lit("DATE").alias("corrected_type"), F.lit("settled").alias("notes"))
    assert pipeline.finalize_labels(spark, base, "entities", one) == 1
    rows = files.read_review(spark, f"{base}/labeled/entities_review")
    assert rows.count() == n and rows.where("notes = 'settled' and is_correct = 'Y' and corrected_type = 'DATE'").count() == 1


def test_sidecars_are_written_once(spark, tmp_path):
    reg = spark.createDataFrame([("A", "a"), ("B", "b")], "celex string, title string")
    path = str(tmp_path / "meta")
    assert files.write_sidecars(spark, reg.where("celex = 'A'"), path).count() == 1
    assert [r["celex"] for r in files.write_sidecars(spark, reg, path).collect()] == ["B"]
    assert files.write_sidecars(spark, reg, path).count() == 0
    assert {r["celex"]: r["title"] for r in spark.read.schema("celex string, title string").json(path).collect()} == {"A": "a", "B": "b"}


def test_answers_quote_the_fitting_passages(spark):
    context = "### Box (ACT)\nRelations:\n  (none found)\nMentioned in:\n  [Act -- article 1]\n  The keeper opens the box.\n\n  [Act -- article 2]\n  Nothing else.\n\n  [Act -- article 3]\n  The keeper seals the box at night."
    df = spark.createDataFrame([(1, "Who seals the box at night?", context), (2, "Whither?", context)], "question_id int, question string, context string")
    got = {r["question_id"]: r["answer"] for r in rag.quote_passages(df).collect()}
    assert got[1] == "- The keeper seals the box at night. [Act -- article 3]" and got[2] == rag.NO_PASSAGE


def test_long_phrases_are_selected(spark):
    name = "the joint board of keepers for the northern tide and cable records of the harbour"
    q = spark.createDataFrame([(1, f"What does {name} do?")], "question_id int, question string")
    nodes = spark.createDataFrame([(name, name, "ORGANIZATION")], "key string, name string, type string")
    assert rag.select_by_words(q, nodes).count() == 1


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "Which fines are set?")], "question_id int, question string")
    nodes = spark.createDataFrame([("administrative penalties", "Penalties", "PENALTY")], "key string, name string, type string")
    syn = spark.createDataFrame([("fines", "Administrative  Penalties")], "phrase string, key string")
    assert rag.select_by_words(q, nodes).count() == 0
    assert rag.select_by_words(q, nodes, syn).first()["name"] == "Penalties"


class Picky:
    def judge(self, row):
        if row["entity_text"] == "bad":
            raise ValueError("no verdict")
        return {"is_correct": row["entity_text"] == "good", "notes": "seen"}


def test_pre_review_fills_only_blank_rows(spark):
    schema = "entity_text string, is_correct string, notes string"
    rows = spark.createDataFrame([("good", "", None), ("other", " ", ""), ("bad", None, ""), ("kept", "N", "mine")], schema)
    wait = review.Patience(attempts=2, busy_wait=0, step_wait=0)
    got = {r["entity_text"]: (r["is_correct"], r["notes"]) for r in review.pre_review(rows, Picky(), wait).collect()}
    assert got["good"] == ("Y", "seen") and got["other"] == ("N", "seen") and got["kept"] == ("N", "mine")
    assert not got["bad"][0] and "no verdict" in got["bad"][1]
    assert review.unlabelled(review.pre_review(rows)).count() == 3


def test_patience():
    slept, calls = [], []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 UNAVAILABLE" if len(calls) == 1 else "odd")
        return "ok"

    assert review.Patience().call(f, slept.append) == "ok" and slept == [65.0, 10.0]
    assert review.is_transient("429 RESOURCE_EXHAUSTED") and not review.is_transient("bad key")
