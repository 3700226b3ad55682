"""Queries of the text problems, with production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import celex_of, key_form, not_blank
from kgspark.llm import mixing, names, packing, quota, residue, sentences, split, terms
from kgspark.plans.problems import sql_key
from kgspark.session import read_table


# --- 1: names
def _names(spark: SparkSession, sf: str) -> DataFrame:
    ex = read_table(spark, sf, "extractions").select("entities", "relations")
    ent = ex.select(F.explode("entities").alias("e")).select(F.col("e.text").alias("raw"), "e.type")
    rel = ex.select(F.explode("relations").alias("r")).select(F.explode(F.array("r.subject", "r.object")).alias("raw"), F.lit(None).cast("string").alias("type"))
    # equal texts first, so that the key form is made once for each
    each = ent.unionByName(rel).groupBy("raw", "type").agg(F.count(F.lit(1)).alias("n"))
    return each.select(key_form("raw").alias("key"), "type", "n")


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling of a person, body or act with its entity."""
    return names.link_names(_names(spark, sf))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of spellings of one entity."""
    return names.name_pairs(p1_links(spark, sf))


# --- 2: oversized texts
def _split(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return split.split_rows(read_table(spark, sf, "chunks").select("seq", "text"), "seq", "text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Natural boundaries (marked paragraphs, list items, set-off paragraphs) of oversized chunks."""
    marks = _split(spark, sf)["boundaries"].where((F.col("kind") != split.SENTENCE) & (F.col("pos") > 1))
    return marks.select("seq", F.col("pos").cast("int").alias("start_pos")).distinct()


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the oversized chunks, numbered within (unit_number, part)."""
    pieces = _split(spark, sf)["pieces"]
    chunks = read_table(spark, sf, "chunks").where(F.length("text") > split.MAX_CHARS).select("seq", "chunk_id", "unit_number", "part")
    return chunks.join(pieces, "seq")


# --- 5: frequencies
def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    ex = read_table(spark, sf, "extractions").select("seq", "chunk_id", "entities", "relations")
    ent = ex.select("seq", "chunk_id", F.explode("entities").alias("e"))
    ent = ent.select("seq", "chunk_id", F.explode(F.array(F.struct(F.lit("entity").alias("f"), F.col("e.text").alias("v")), F.struct(F.lit("type").alias("f"), F.col("e.type").alias("v")))).alias("x"))
    rel = ex.select("seq", "chunk_id", F.explode("relations").alias("r")).select("seq", "chunk_id", F.struct(F.lit("relation").alias("f"), F.col("r.relation").alias("v")).alias("x"))
    both = ent.unionByName(rel)
    return both.where(not_blank("x.v")).select(F.col("x.f").alias("field_name"), key_form("x.v").alias("field_value"), F.col("chunk_id").alias("record"), F.col("seq").alias("row_id"))


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct value with occurrences, distinct chunks and its mark."""
    total = read_table(spark, sf, "extractions").agg(F.countDistinct("chunk_id").alias("n")).scalar()
    return terms.mark_terms(terms.term_frequencies(_pairs(spark, sf)), total)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are too rare or too common."""
    return p5_terms(spark, sf).where("mark is not null").select("field_name", "field_value", "mark")


# --- 6: sentences
def p6_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of every chunk."""
    return sentences.sentence_units(read_table(spark, sf, "chunks").select("seq", "text"), "seq", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """First character of every sentence."""
    return p6_sentences(spark, sf).select("seq", F.col("start_pos").cast("int").alias("start_pos")).distinct()


# --- 7: samples
def _quota(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    ex = read_table(spark, sf, "extractions").select("chunk_id", F.explode("entities").alias("e"))
    ent = ex.where(not_blank("e.text")).select(F.lit("entities").alias("pool"), key_form("e.type").alias("category"), key_form("e.text").alias("name"), "chunk_id")
    ent = ent.select("pool", "category", F.to_json(F.struct("chunk_id", "name"), {"ignoreNullFields": "false"}).alias("item"))
    kind = F.when(F.col("chunk_id").contains("_recital_"), "recital").when(F.col("chunk_id").contains("_article_"), "article")
    rel = read_table(spark, sf, "relations_review").select(F.lit("relations").alias("pool"), F.concat(celex_of("chunk_id"), F.lit("|"), kind).alias("category"), F.col("chunk_id").alias("item"))
    return quota.quota_sample(ent.unionByName(rel), read_table(spark, sf, "sample_targets"))


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The samples of all plans."""
    return _quota(spark, sf)["sample"]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """What each target needed, had and got."""
    return _quota(spark, sf)["report"]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that cannot be met."""
    return p7_report(spark, sf).where("short").select("plan_id", "category").distinct()


# --- 8: containers
def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its container."""
    return packing.pack_containers(read_table(spark, sf, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    return packing.packing_report(p8_pack(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that had to be cut."""
    return p8_pack(spark, sf).where("n_pieces > 1").select("doc_id").distinct()


# --- 9: mixing
def _mix(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return mixing.mix_sources(read_table(spark, sf, "documents").select("doc_id", "source", "text"), read_table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed corpus as document references, shard by shard in shuffled order."""
    return mixing.shuffled_shards(_mix(spark, sf)["mix"])


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shares asked for and reached."""
    return _mix(spark, sf)["report"]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fall short of their share."""
    return p9_report(spark, sf).where("short").select("source")


# --- 10: residue
def p10_residue(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with text: its class, its near-duplicate component and the verdict."""
    return residue.find_residue(read_table(spark, sf, "documents"))


def p10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Verified links between the representatives of classes of equal texts."""
    return residue.representative_pairs(residue.near_duplicates(read_table(spark, sf, "documents")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold residue."""
    return p10_residue(spark, sf).where("residue").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (
    p1_found, p1_links, p2_found, p2_pieces, p5_found, p5_terms, p6_found, p6_sentences, p7_found, p7_sample, p7_report,
    p8_found, p8_pack, p8_report, p9_found, p9_mix, p9_report, p10_found, p10_residue, p10_near_duplicates,
)}

_P5 = f"""
WITH e AS (SELECT chunk_id, unnest(entities) AS e FROM extractions), r AS (SELECT chunk_id, unnest(relations) AS r FROM extractions),
p AS (SELECT 'entity' AS field_name, {sql_key("e.text")} AS field_value, chunk_id FROM e
UNION ALL SELECT 'type', {sql_key("e.type")}, chunk_id FROM e UNION ALL SELECT 'relation', {sql_key("r.relation")}, chunk_id FROM r),
f AS (SELECT field_name, field_value, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM p WHERE field_value <> '' GROUP BY ALL),
t AS (SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records * 10 > (SELECT count(DISTINCT chunk_id) FROM extractions) THEN 'common' END AS mark FROM f)
"""

_P7 = f"""
WITH i AS (SELECT DISTINCT 'entities' AS pool, category, item FROM (SELECT {sql_key("e.type")} AS category, (chunk_id, {sql_key("e.text")})::VARCHAR AS item
FROM (SELECT chunk_id, unnest(entities) AS e FROM extractions) WHERE {sql_key("e.text")} <> '')
UNION ALL SELECT DISTINCT 'relations', split_part(split_part(chunk_id, '_recital_', 1), '_article_', 1) || '|' ||
CASE WHEN contains(chunk_id, '_recital_') THEN 'recital' WHEN contains(chunk_id, '_article_') THEN 'article' END, chunk_id FROM relations_review),
c AS (SELECT pool, category, count(*) AS n FROM i GROUP BY ALL)
SELECT DISTINCT plan_id, t.category FROM sample_targets t LEFT JOIN c ON t.pool = c.pool AND t.category = c.category
WHERE coalesce(n, 0) < greatest(min_rows, -((-target_permille::BIGINT * sample_size) // 1000))
"""

ORACLES = {
    "p5_terms": _P5 + "SELECT field_name, field_value, occurrences, records, mark FROM t",
    "p5_found": _P5 + "SELECT field_name, field_value, mark FROM t WHERE mark IS NOT NULL",
    "p7_found": _P7.replace("-((-target_permille::BIGINT * sample_size) // 1000)", "ceil(target_permille::BIGINT * sample_size / 1000.0)::BIGINT"),
}
