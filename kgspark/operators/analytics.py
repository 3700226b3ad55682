"""Counts and overlaps over the flat mention and relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import celex_of


def count_by(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows per value, largest first, ties by value."""
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def top_mentions(mentions: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent (key, type)."""
    return count_by(mentions, "key", "type").limit(k)


def with_titles(rows: DataFrame, registry: DataFrame, width: int = 60) -> DataFrame:
    """Adds ``document``: the first ``width`` characters of the act's title, NULL where it is not registered."""
    titles = registry.select("celex", F.substring("title", 1, width).alias("document")).dropDuplicates(["celex"])
    return rows.join(titles, "celex", "left")


def documents_per_key(titled: DataFrame) -> DataFrame:
    """(key, documents): distinct documents of keys that occur in more than one.

    Grouped by (key, document) first, so the distinct count of a hot key is spread over its documents.
    """
    pairs = titled.where("document is not null").groupBy("key", "document").agg(F.lit(1).alias("x"))
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")


def document_lists(titled: DataFrame) -> DataFrame:
    """(key, documents, list): as ``documents_per_key`` with the sorted titles."""
    pairs = titled.where("document is not null").select("key", "document").distinct()
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.array_sort(F.collect_list("document")), " | ").alias("list")).where("documents > 1")


def volume_per_document(ment: DataFrame, rel: DataFrame) -> DataFrame:
    """(document, entities, relations), NULL where a document has none."""
    a = ment.where("document is not null").groupBy("document").agg(F.count(F.lit(1)).alias("entities"))
    b = rel.where("document is not null").groupBy("document").agg(F.count(F.lit(1)).alias("relations"))
    return a.join(b, "document", "full")


def corpus_counts(ex: DataFrame) -> DataFrame:
    """One row: records, mentions, relations, distinct documents; no explode needed."""
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0))
    docs = ex.select(celex_of("chunk_id").alias("c")).distinct().agg(F.count("c").alias("n")).scalar()
    return ex.agg(F.count(F.lit(1)).alias("records"), size("entities").alias("mentions"), size("relations").alias("relations")).select("records", "mentions", "relations", docs.alias("documents"))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    """(celex, chunks, recitals, articles)."""
    return chunks.groupBy("celex").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "recital").alias("recitals"), F.count_if(F.col("chunk_type") == "article").alias("articles"))
