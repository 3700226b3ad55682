"""Property graph as DataFrames: node and edge upserts, canonical types, neighbourhoods, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import (
    ENTITY_TYPES, RELATION_TYPES, celex_of, is_self_reference, key_form, not_blank, relation_line, truncate_at_sentence,
)

MAX_RELATIONS, MAX_CHUNKS, CONTEXT_CHARS, TITLE_CHARS = 15, 5, 600, 50


def mentions(ex: DataFrame) -> DataFrame:
    """(seq, pos, chunk_id, celex, text, type, key): one row per element of ``entities``, NULL elements kept out."""
    rows = ex.select("seq", "chunk_id", F.posexplode("entities").alias("pos", "e")).where("e is not null")
    return rows.select("seq", "pos", "chunk_id", celex_of("chunk_id").alias("celex"), "e.text", "e.type", key_form("e.text").alias("key"))


def relations(ex: DataFrame) -> DataFrame:
    """(seq, pos, chunk_id, celex, subject, relation, object): one row per element of ``relations``."""
    rows = ex.select("seq", "chunk_id", F.posexplode("relations").alias("pos", "r")).where("r is not null")
    return rows.select("seq", "pos", "chunk_id", celex_of("chunk_id").alias("celex"), "r.subject", "r.relation", "r.object")


def usable_mentions(ex: DataFrame) -> DataFrame:
    """Mentions that enter the graph: known type, text present, no self-reference."""
    return mentions(ex).where(F.col("type").isin(ENTITY_TYPES) & not_blank("text") & ~is_self_reference("text"))


def arrival() -> Column:
    """Order of arrival (seq, pos) as one number: aggregates over it stay in fixed-width hash buffers."""
    return F.col("seq").cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(10,0)") + F.col("pos")


def spellings(ex: DataFrame) -> DataFrame:
    """(key, type, text, n, first): mentions compressed to distinct spellings and types.

    All a later vote or display name needs.  It is a hash aggregation on the map side, so a key with a third
    of all mentions costs a few rows per task, and nothing sorts the mentions.
    """
    return usable_mentions(ex).groupBy("key", "type", "text").agg(F.count(F.lit(1)).alias("n"), F.min(arrival()).alias("first"))


def _elected(ex: DataFrame) -> DataFrame:
    """(key, name, type, votes) in one scan: spellings, then types of a key, then keys."""
    votes = spellings(ex).groupBy("key", "type").agg(F.sum("n").alias("n"), F.min_by("text", "first").alias("name"), F.min("first").alias("first"))
    best = votes.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("nn"), "first", "type")).alias("b"), F.min_by("name", "first").alias("name"))
    return best.select("key", "name", "b.type", (-F.col("b.nn")).alias("votes"))


def canonical_types(ex: DataFrame) -> DataFrame:
    """(key, type, votes): the most frequent type of a key, ties to the type seen first."""
    return _elected(ex).select("key", "type", "votes")


def entity_nodes(ex: DataFrame) -> DataFrame:
    """(key, name, type): name is the spelling seen first, type the canonical one."""
    return _elected(ex).select("key", "name", "type")


def document_nodes(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(celex, title): registry title, else the title loaded last with a chunk, else ''."""
    loaded = chunks.where("celex is not null").groupBy("celex").agg(F.max_by("doc_title", "seq").alias("loaded"))
    both = loaded.join(registry.select("celex", "title").dropDuplicates(["celex"]), "celex", "full")
    return both.select("celex", F.coalesce(F.nullif("title", F.lit("")), F.nullif("loaded", F.lit("")), F.lit("")).alias("title"))


def last_loaded(chunks: DataFrame) -> DataFrame:
    """(chunk_id, seq, celex) of the row loaded last for every chunk_id: all that a choice of chunks needs, without texts."""
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("seq", "celex")).alias("m")).select("chunk_id", "m.seq", "m.celex")


def chunk_nodes(chunks: DataFrame, ex: DataFrame) -> DataFrame:
    """Chunks that have an extraction; of repeated ids the row loaded last wins.  ``seq`` is unique, so texts are moved once."""
    cols = ["chunk_id", "celex", "chunk_type", "unit_number", "part", "heading", "text"]
    last = last_loaded(chunks.select("chunk_id", "seq", "celex")).join(ex.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return chunks.join(last.select("seq"), "seq", "left_semi").select(*cols)


def has_chunk_edges(chunks: DataFrame, ex: DataFrame) -> DataFrame:
    """Distinct (celex, chunk_id)."""
    return chunks.join(ex.select("chunk_id").distinct(), "chunk_id", "left_semi").where("celex is not null").select("celex", "chunk_id").distinct()


def mention_edges(ex: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, key) of chunks that exist."""
    return usable_mentions(ex).select("chunk_id", "key").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def relation_edges(ex: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct (src, rel, dst) whose ends are entities of the same record; no shuffle before the distinct.

    ``exact`` resolves ends by their exact spelling instead of their key.
    """
    ok = F.filter(F.coalesce("entities", F.array().cast(ex.schema["entities"].dataType)), lambda e: e["type"].isin(ENTITY_TYPES) & not_blank(e["text"]) & ~is_self_reference(e["text"]))
    known = F.transform(ok, lambda e: e["text"] if exact else key_form(e["text"]))
    rows = ex.select(known.alias("known"), F.explode("relations").alias("r")).where(F.col("r.relation").isin(RELATION_TYPES))
    src, dst = (F.col("r.subject"), F.col("r.object")) if exact else (key_form("r.subject"), key_form("r.object"))
    rows = rows.where(F.array_contains("known", src) & F.array_contains("known", dst))
    return rows.select(key_form("r.subject").alias("src"), F.col("r.relation").alias("rel"), key_form("r.object").alias("dst")).distinct()


def grounded_relations(ex: DataFrame) -> DataFrame:
    """(seq, pos, subject, relation, object): relations both of whose ends are spelled among the record's entities."""
    keys = F.transform(F.coalesce("entities", F.array().cast(ex.schema["entities"].dataType)), lambda e: key_form(e["text"]))
    rows = ex.select("seq", keys.alias("keys"), F.posexplode("relations").alias("pos", "r")).where("r is not null")
    rows = rows.where(F.array_contains("keys", key_form("r.subject")) & F.array_contains("keys", key_form("r.object")))
    return rows.select("seq", "pos", "r.subject", "r.relation", "r.object")


def cooccurring_relations(ex: DataFrame, relation: str = "REFERENCES") -> DataFrame:
    """Rule default: neighbouring mentions of a record with at least two entities refer to each other."""
    e = F.filter("entities", lambda x: x.isNotNull() & not_blank(x["text"]))
    rows = ex.select("seq", e.alias("e")).where("size(e) >= 2")
    pairs = F.arrays_zip(F.slice("e", F.lit(1), F.size("e") - 1).alias("a"), F.slice("e", F.lit(2), F.size("e") - 1).alias("b"))
    out = rows.select("seq", F.posexplode(pairs).alias("pos", "p")).where(key_form("p.a.text") != key_form("p.b.text"))
    return out.select("seq", "pos", F.col("p.a.text").alias("subject"), F.lit(relation).alias("relation"), F.col("p.b.text").alias("object"))


def pk_violations(nodes: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(node, id, n): primary keys that occur more than once; empty when the constraints hold."""
    out = None
    for name, (df, pk) in nodes.items():
        bad = df.groupBy(F.col(pk).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("node"), "id", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


def neighborhood(edges: DataFrame, k: int = MAX_RELATIONS) -> DataFrame:
    """(key, rank, rel, other, outgoing): up to ``k`` edges of every entity in either direction, a self-loop once."""
    end = lambda a, b, out: F.struct(F.col(a).alias("key"), F.col(b).alias("other"), F.lit(out).alias("outgoing"))
    ends = F.when(F.col("src") == F.col("dst"), F.array(end("src", "dst", True))).otherwise(F.array(end("src", "dst", True), end("dst", "src", False)))
    both = edges.select("rel", F.explode(ends).alias("e")).select("e.key", "rel", "e.other", "e.outgoing")
    w = W.partitionBy("key").orderBy("rel", "other", F.desc("outgoing"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context_chunks(edges: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = MAX_CHUNKS) -> DataFrame:
    """(key, rank, chunk_id, citation, excerpt): up to ``k`` chunks that mention an entity (edges: chunk_id, key).

    The rank is taken on the narrow edge table; excerpts are cut before the join, so of every kept chunk at most
    ``CONTEXT_CHARS`` characters are moved.
    """
    w = W.partitionBy("key").orderBy("celex", "chunk_id")
    ids = last_loaded(chunks.select("chunk_id", "seq", "celex"))
    top = edges.join(ids, "chunk_id").where("celex is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    text = truncate_at_sentence(F.coalesce("text", F.lit("")), CONTEXT_CHARS)
    own = chunks.select("seq", "chunk_type", F.col("unit_number").cast("string").alias("unit"), text.alias("excerpt"))
    rows = top.select("key", "rank", "chunk_id", "seq", "celex").join(own, "seq").join(docs, "celex")
    cite = F.concat(F.lit("["), F.substring("title", 1, TITLE_CHARS), F.lit(" -- "), "chunk_type", F.lit(" "), "unit", F.lit("]"))
    return rows.select("key", "rank", "chunk_id", cite.alias("citation"), "excerpt")


def relation_lines(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, rank, line): neighbourhood edges as text, oriented from subject to object."""
    a = nodes.select("key", F.col("name").alias("a_name"))
    b = nodes.select(F.col("key").alias("other"), F.col("name").alias("b_name"))
    rows = near.join(a, "key").join(b, "other")
    return rows.select("key", "rank", relation_line(F.col("a_name"), F.col("rel"), F.col("b_name"), F.col("outgoing")).alias("line"))


def context_sections(selected: DataFrame, lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, section) for entities (key, name, type): heading, relations, citations with excerpts."""
    join_ranked = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    rel = lines.groupBy("key").agg(F.array_join(join_ranked("line"), "\n").alias("rel"))
    part = chunks.withColumn("part", F.concat(F.lit("  "), "citation", F.lit("\n  "), "excerpt"))
    cite = part.groupBy("key").agg(F.array_join(join_ranked("part"), "\n\n").alias("cite"))
    rows = selected.join(rel, "key", "left").join(cite, "key", "left")
    return rows.select("key", F.concat(
        F.lit("### "), "name", F.lit(" ("), "type", F.lit(")\nRelations:\n"), F.coalesce("rel", F.lit("  (none found)")),
        F.lit("\nMentioned in:\n"), F.coalesce("cite", F.lit("  (no chunks found)")),
    ).alias("section"))


def known_names(candidates: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """(group, rank, name): candidates (group, pos, name) that match a known (key, name); order kept, repeats dropped."""
    c = candidates.select(group, "pos", key_form("name").alias("key")).groupBy(group, "key").agg(F.min("pos").alias("pos"))
    hit = c.join(known.select("key", "name"), "key")
    return hit.select(group, F.row_number().over(W.partitionBy(group).orderBy("pos")).alias("rank"), "name")
