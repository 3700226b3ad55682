"""Graph operators on small hand-written extraction records."""

from kgspark.operators import analytics, evaluate, graph, rag

EX = "seq bigint, chunk_id string, entities array<struct<text:string,type:string>>, relations array<struct<subject:string,relation:string,object:string>>"


def records(spark, *rows):
    return spark.createDataFrame([(i, c, e, r) for i, (c, e, r) in enumerate(rows)], EX)


def sample(spark):
    return records(
        spark,
        ("D_article_1_0", [("ENISA", "LEGAL_ACT"), ("Board", "ORGANIZATION"), ("this Regulation", "LEGAL_ACT")], [("enisa", "AMENDS", "Board"), ("ENISA", "AMENDS", "Board"), ("ENISA", "LIKES", "Board")]),
        ("D_article_1_0", [("enisa ", "ORGANIZATION"), ("Board", "BOGUS"), ("ENISA", "ORGANIZATION")], [("ENISA", "DEFINES", "enisa ")]),
        ("E_recital_2_0", [("Board", "LEGAL_ACT")], None),
        ("gone_recital_1_0", [("Board", "ORGANIZATION"), None, ("", "DATE"), (None, "DATE")], []),
        ("E_recital_3_0", None, [("Board", "AMENDS", "Board")]),
    )


def test_canonical_type_majority_and_first_seen_tie(spark):
    got = {r["key"]: (r["type"], r["votes"]) for r in graph.canonical_types(sample(spark)).collect()}
    assert got["enisa"] == ("ORGANIZATION", 2)
    assert got["board"] == ("ORGANIZATION", 2)
    tie = records(spark, ("a", [("X", "DATE")], None), ("a", [("x", "PENALTY")], None))
    assert graph.canonical_types(tie).first()["type"] == "DATE"
    assert "this regulation" not in got and "" not in got
    assert graph.canonical_types(records(spark, ("a", [], []))).count() == 0


def test_nodes_and_edges(spark):
    ex = sample(spark)
    assert {(r["key"], r["name"]) for r in graph.entity_nodes(ex).collect()} == {("enisa", "ENISA"), ("board", "Board")}
    edges = {tuple(r) for r in graph.relation_edges(ex).collect()}
    assert edges == {("enisa", "AMENDS", "board"), ("enisa", "DEFINES", "enisa")}
    exact = {tuple(r) for r in graph.relation_edges(ex, exact=True).collect()}
    assert exact == edges  # the case-mismatched relation also occurs spelled exactly
    chunks = spark.createDataFrame([("D_article_1_0", 1)], "chunk_id string, seq int")
    assert {tuple(r) for r in graph.mention_edges(ex, chunks).collect()} == {("D_article_1_0", "enisa"), ("D_article_1_0", "board")}


def test_neighborhood_both_directions_self_loop_once(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("c", "R", "a"), ("a", "S", "a")], "src string, rel string, dst string")
    got = {(r["key"], r["rel"], r["other"], r["outgoing"]) for r in graph.neighborhood(edges).collect()}
    assert got == {("a", "R", "b", True), ("a", "R", "c", False), ("a", "S", "a", True), ("b", "R", "a", False), ("c", "R", "a", True)}
    many = spark.createDataFrame([("hub", "R", f"n{i:02d}") for i in range(40)], "src string, rel string, dst string")
    assert graph.neighborhood(many).where("key = 'hub'").count() == 15


def test_grounding_and_cooccurrence(spark):
    ex = records(spark, ("a", [("ENISA", "X"), ("Commission", "X")], [("enisa", "R", " commission"), ("ENISA", "R", "other"), None]), ("b", [("One", "X")], [("One", "R", "Two")]))
    assert [(r["subject"], r["object"]) for r in graph.grounded_relations(ex).collect()] == [("enisa", " commission")]
    assert [(r["subject"], r["object"]) for r in graph.cooccurring_relations(ex).collect()] == [("ENISA", "Commission")]


def test_known_names(spark):
    cand = spark.createDataFrame([(1, 0, "board"), (1, 1, "nobody"), (1, 2, " ENISA"), (1, 3, "BOARD")], "q int, pos int, name string")
    known = spark.createDataFrame([("enisa", "Enisa"), ("board", "The Board")], "key string, name string")
    got = [(r["rank"], r["name"]) for r in graph.known_names(cand, known, "q").orderBy("rank").collect()]
    assert got == [(1, "The Board"), (2, "Enisa")]


def test_context_without_relations_or_chunks(spark):
    sel = spark.createDataFrame([("k", "Name", "DATE")], "key string, name string, type string")
    lines = spark.createDataFrame([], "key string, rank int, line string")
    passages = spark.createDataFrame([], "key string, rank int, chunk_id string, citation string, excerpt string")
    text = graph.context_sections(sel, lines, passages).first()["section"]
    assert text == "### Name (DATE)\nRelations:\n  (none found)\nMentioned in:\n  (no chunks found)"


def test_answers(spark):
    ex = sample(spark)
    chunks = spark.createDataFrame([(1, "D_article_1_0", "D", "Title", "article", 1, 0, "h", "Some text.")], "seq int, chunk_id string, celex string, doc_title string, chunk_type string, unit_number int, part int, heading string, text string")
    reg = spark.createDataFrame([("D", "")], "celex string, title string")
    q = spark.createDataFrame([(1, "What does ENISA do?"), (2, "Nothing known")], "question_id int, question string")
    got = {r["question_id"]: r for r in rag.answer_questions(q, ex, chunks, reg).collect()}
    assert [e["key"] for e in got[1]["entities"]] == ["enisa"] and "ENISA --AMENDS--> Board" in got[1]["context"] and "[Title -- article 1]" in got[1]["context"]
    assert got[2]["answer"] == rag.NO_MATCH and got[2]["entities"] == [] and got[2]["context"] == ""


def test_precision_of_empty_sample(spark):
    empty = spark.createDataFrame([], "is_correct string, entity_type string")
    r = evaluate.precision(empty).first()
    assert (r["correct"], r["total"], r["precision"]) == (0, 0, None)
    assert evaluate.relation_gap(empty, empty).first()["gap"] is None
    assert "n/a" in evaluate.report(empty, empty)


def test_small_sample_caveat(spark):
    rows = spark.createDataFrame([("Y", "DATE")] * 3 + [("N", "DATE")], "is_correct string, entity_type string")
    assert evaluate.relation_gap(rows, rows).first()["small_sample"] is True
    assert evaluate.percent(0.625, 0) == "62%"


def test_spot_check(spark):
    schema = "id string, is_correct string"
    none = spark.createDataFrame([("a", "N"), ("b", "N")], schema)
    assert evaluate.spot_check(none, ["id"]).count() == 2
    mixed = spark.createDataFrame([(f"y{i}", "Y") for i in range(11)] + [("n", "N")], schema)
    got = evaluate.spot_check(mixed, ["id"])
    assert got.where("is_correct = 'Y'").count() == 2 and got.where("is_correct = 'N'").count() == 1
    assert evaluate.spot_check(spark.createDataFrame([("y", "Y")], schema), ["id"]).count() == 1


def test_labelling_sample_with_few_recitals(spark):
    rows = [(f"D_article_{i}_0", [("a", "DATE")] * 3, []) for i in range(9)] + [("D_recital_1_0", [("a", "DATE")] * 2, []), ("D_recital_2_0", [("a", "DATE")] * 7, [])]
    got = evaluate.labelling_sample(records(spark, *rows)).groupBy("stratum").count().collect()
    assert {(r["stratum"], r["count"]) for r in got} == {("article", 3), ("recital", 1)}


def test_verdicts_hit_repeated_rows(spark):
    rows = spark.createDataFrame([("c", "t", "", ""), ("c", "t", "", ""), ("c", None, "Y", "")], "chunk_id string, entity_text string, is_correct string, notes string")
    v = spark.createDataFrame([("c", "t", "N"), ("c", "", "N")], "chunk_id string, entity_text string, is_correct string")
    got = evaluate.overlay_verdicts(rows, v, ["chunk_id", "entity_text"], ["is_correct"])
    assert got.where("applied and is_correct = 'N'").count() == 3


def test_volume_is_a_full_join(spark):
    a = spark.createDataFrame([("x",)], "document string")
    b = spark.createDataFrame([("y",), ("y",), (None,)], "document string")
    assert {tuple(r) for r in analytics.volume_per_document(a, b).collect()} == {("x", 1, None), ("y", None, 2)}


def test_pk_violations(spark):
    a = spark.createDataFrame([("1",), ("1",), ("2",)], "id string")
    assert [tuple(r) for r in graph.pk_violations({"n": (a, "id"), "m": (a.distinct(), "id")}).collect()] == [("n", "1", 2)]
