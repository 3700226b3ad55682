"""Question -> entities -> neighbourhood and passages -> answer, for a table of questions at once.

The rule default of entity selection joins the word n-grams of a question with entity keys; the rule default
of synthesis quotes the passages that fit the question best.  Both can be replaced by a model: ``select`` and ``synthesise`` are DataFrame
functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import key_form
from kgspark.operators import graph
from kgspark.operators.skew import global_rank
from kgspark.session import materialize

NO_MATCH = "No entity of the graph matches this question."
NO_PASSAGE = "The context does not answer this question."
ANSWER_PASSAGES = 5


def select_by_words(questions: DataFrame, nodes: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(question_id, pos, key, name, type): entities whose key is a phrase of the question, in order of appearance.

    ``synonyms`` (phrase, key) adds phrases that stand for an entity.
    """
    words = F.split(F.trim(F.regexp_replace(key_form("question"), r"[^\p{L}\p{N}\s'()/.-]", " ")), r"\s+")
    q = questions.select("question_id", F.transform(words, lambda x: F.regexp_replace(x, r"[.]+$", "")).alias("w"))
    at = q.select("question_id", "w", F.posexplode("w").alias("pos", "x"))
    grams = at.select("question_id", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("pos")), lambda n: F.array_join(F.slice("w", F.col("pos") + 1, n), " "))).alias("key"))
    if synonyms is not None:
        other = grams.withColumnRenamed("key", "phrase").join(synonyms.select(key_form("phrase").alias("phrase"), key_form("key").alias("key")), "phrase")
        grams = grams.unionByName(other.select(grams.columns))
    hit = grams.join(nodes, "key").groupBy("question_id", "key", "name", "type").agg(F.min("pos").alias("pos"))
    return hit.select("question_id", "pos", "key", "name", "type")


def quote_passages(answers: DataFrame, k: int = ANSWER_PASSAGES) -> DataFrame:
    """Rule default of synthesis: the ``k`` passages of the context that share most words with the question, each with its citation.

    Words of up to three letters do not count; ties go to the passage that comes first; a passage cited for several
    entities is quoted once.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), lambda x: F.length(x) > 3)
    cited = F.expr(r"regexp_extract_all(context, '(?m)^  (\\[[^\\n]* -- [^\\n]*\\])\\n  [^\\n]*', 1)")
    quoted = F.expr(r"regexp_extract_all(context, '(?m)^  \\[[^\\n]* -- [^\\n]*\\]\\n  ([^\\n]*)', 1)")
    rows = answers.withColumn("_p", F.transform(F.arrays_zip(cited.alias("c"), quoted.alias("t")), lambda x, i: F.struct((-F.size(F.array_intersect(words(x["t"]), words(F.col("question"))))).alias("score"), i.alias("i"), x["c"].alias("c"), x["t"].alias("t"))))
    best = F.slice(F.array_sort(F.filter("_p", lambda x, i: (x["score"] < 0) & (F.array_position(F.transform("_p", lambda y: y["t"]), x["t"]) == i + 1))), 1, k)
    lines = F.transform(best, lambda x: F.concat(F.lit("- "), x["t"], F.lit(" "), x["c"]))
    return rows.withColumn("answer", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_PASSAGE))).drop("_p")


def answer_questions(
    questions: DataFrame, ex: DataFrame, chunks: DataFrame, registry: DataFrame,
    select: Callable[[DataFrame, DataFrame], DataFrame] = select_by_words, synthesise: Callable[[DataFrame], DataFrame] = quote_passages,
) -> DataFrame:
    """(question_id, question, answer, entities, context) for every question; without entities a fixed message."""
    nodes = materialize(graph.entity_nodes(ex), "rag-nodes")  # for the selection, both ends of the edges and the sections
    chosen = materialize(select(questions, nodes), "rag-chosen")
    keys = chosen.select("key").distinct()
    edges = graph.relation_edges(ex)
    touching = edges.join(keys.select(F.col("key").alias("src")), "src", "left_semi").unionByName(edges.join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "rel", "dst")).distinct()
    near = graph.neighborhood(touching).join(keys, "key", "left_semi")
    lines = graph.relation_lines(near, nodes)
    docs = graph.document_nodes(chunks, registry)
    ment = graph.mention_edges(ex, chunks).join(keys, "key", "left_semi")
    passages = graph.context_chunks(ment, chunks, docs)
    sections = graph.context_sections(nodes.join(keys, "key", "left_semi"), lines, passages)
    rows = chosen.join(sections, "key")
    order = F.array_sort(F.collect_list(F.struct("pos", "key", "name", "type", "section")))
    per = rows.groupBy("question_id").agg(order.alias("s"))
    per = per.select("question_id", F.transform("s", lambda x: F.struct(x["key"].alias("key"), x["name"].alias("name"), x["type"].alias("type"))).alias("entities"), F.array_join(F.transform("s", lambda x: x["section"]), "\n\n").alias("context"))
    both = questions.join(per, "question_id", "left")
    found = synthesise(both.where("context is not null"))
    none = both.where("context is null").withColumn("answer", F.lit(NO_MATCH)).withColumn("context", F.lit("")).withColumn("entities", F.array().cast("array<struct<key:string,name:string,type:string>>"))
    cols = ["question_id", "question", "answer", "entities", "context"]
    return found.select(*cols).unionByName(none.select(*cols))


def history(rows: DataFrame, tie: str, k: int | None = None) -> DataFrame:
    """``rows`` of (ts, ...) with ``rank``, newest first, ties by ``tie``; all of them, or the ``k`` newest."""
    if k is not None:
        rows = rows.orderBy(F.desc("ts"), tie).limit(k)
    return global_rank(rows, [F.desc("ts"), F.col(tie)])


def entity_names(nodes: DataFrame) -> DataFrame:
    """Distinct names in order."""
    return nodes.select("name").distinct().orderBy("name")


def entity_overview(ex: DataFrame, k: int = 20) -> DataFrame:
    """(rank, key, name, type, mentions, documents): the entities mentioned most."""
    m = graph.usable_mentions(ex)
    # (key, document) before key: neither the count nor the distinct count gathers a hot key in one task
    per = m.groupBy("key", "celex").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("mentions"), F.count("celex").alias("documents"))
    top = per.orderBy(F.desc("mentions"), "key").limit(k)
    out = top.join(graph.entity_nodes(ex), "key")
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mentions"), "key"))).select("rank", "key", "name", "type", "mentions", "documents")
