"""The steps of the pipeline over stored tables: ingest, chunk, extract (resumable), retry, label, load, evaluate.

Every step reads what the step before has written, so a failed step is repeated alone.  ``base`` is a folder
on the cluster's file system.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import chunking, evaluate, extract, graph, ingest, review
from kgspark.session import materialize
from kgspark.sources import files


def ingest_pages(spark: SparkSession, base: str, registry: DataFrame, to_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """Raw documents below ``raw/`` to parsed documents; a document without title takes the registry's."""
    pages = files.read_pages(spark, f"{base}/raw", to_pages)
    parsed = ingest.parse_documents(ingest.page_text(pages), registry)
    files.write_partitioned(parsed, f"{base}/processed")
    out = spark.read.parquet(f"{base}/processed")
    if not out.limit(1).count():
        raise FileNotFoundError(f"no document below {base}/raw")
    return out


def chunk_all(spark: SparkSession, base: str) -> DataFrame:
    """Parsed documents to chunks, numbered by arrival: by document, recitals before articles, units and parts in order.

    The order comes from a distributed sort; ``seq`` increases with it and has gaps between the sort's partitions.
    """
    chunks = chunking.chunk_documents(spark.read.parquet(f"{base}/processed"), with_order=True)
    ordered = chunks.orderBy("celex", F.col("chunk_type") != "recital", "ord", "part")
    chunks = materialize(ordered.withColumn("seq", F.monotonically_increasing_id()).drop("ord"), "chunks-ordered")
    files.write_partitioned(chunks, f"{base}/chunks")
    return spark.read.parquet(f"{base}/chunks")


def extract_sample(spark: SparkSession, base: str, backend: extract.Backend | None = None, per_document: int = 10, least_chars: int = 150) -> dict[str, DataFrame]:
    """A first look before the full run: some long chunks of every document are extracted and written as JSON arrays.

    Returns the ``records`` and ``counts`` (kind, type, n) of the entity and relation types found.
    """
    chunks = spark.read.parquet(f"{base}/chunks").where(F.length("text") > least_chars)
    sample = materialize(evaluate.sample_per_group(chunks.select("seq", "celex", "chunk_id", "text"), "celex", "seq", per_document), "sample-chunks")
    out = materialize(extract.run(sample, backend or extract.RuleBackend()), "sample")
    records = sample.select("seq", "celex", "chunk_id").join(out.select("chunk_id", "entities", "relations"), "chunk_id")
    files.write_arrays(records.select("celex", "chunk_id", "entities", "relations"), f"{base}/extraction_sample")
    types = lambda kind, col, field: out.select(F.explode(f"{col}.{field}").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return {"records": records, "counts": types("entity", "entities", "type").unionByName(types("relation", "relations", "relation"))}


def extract_pending(spark: SparkSession, base: str, backend: extract.Backend | None = None, timeout: float | None = None, retry_failed: bool = False) -> DataFrame:
    """Extract what has no result yet; failures go to a table of their own and are tried again by the next call.

    ``retry_failed`` restricts the run to the chunks in the failure table (for a second backend).
    """
    chunks = spark.read.parquet(f"{base}/chunks").groupBy("chunk_id").agg(F.max_by("text", "seq").alias("text"))
    done, failed = files.stored(spark, f"{base}/extraction"), files.stored(spark, f"{base}/failures")
    todo = extract.pending(chunks, done) if done is not None else chunks
    if retry_failed:
        todo = todo.join(failed.select("chunk_id").distinct(), "chunk_id", "left_semi") if failed is not None else todo.limit(0)
    out = materialize(extract.run(todo, backend or extract.RuleBackend(), timeout), "extraction")
    files.append_results(out.where("status = 'ok'"), f"{base}/extraction")
    files.append_results(out.where("status <> 'ok'"), f"{base}/failures")
    return spark.read.parquet(f"{base}/extraction")


def extraction_records(spark: SparkSession, base: str) -> DataFrame:
    """Extraction results as records with the order of their chunks."""
    chunks = spark.read.parquet(f"{base}/chunks").groupBy("chunk_id").agg(F.max("seq").alias("seq"))
    return spark.read.parquet(f"{base}/extraction").join(chunks, "chunk_id").select("seq", "chunk_id", "entities", "relations")


def labelling_files(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Review CSVs of a stratified sample, labels blank."""
    ex = extraction_records(spark, base)
    rows = evaluate.review_rows(evaluate.labelling_sample(ex), ex, spark.read.parquet(f"{base}/chunks"))
    for name, df in rows.items():
        files.write_review(df.drop("seq", "pos"), f"{base}/labeled/{name}_review")
    return rows


def load_graph(spark: SparkSession, base: str, registry: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables, replaced as a whole."""
    ex, chunks = extraction_records(spark, base), spark.read.parquet(f"{base}/chunks")
    tables = {
        "documents": graph.document_nodes(chunks, registry), "chunks": graph.chunk_nodes(chunks, ex), "entities": graph.entity_nodes(ex),
        "has_chunk": graph.has_chunk_edges(chunks, ex), "mentions": graph.mention_edges(ex, chunks), "relations": graph.relation_edges(ex),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/graph/{name}")
    stored = {name: spark.read.parquet(f"{base}/graph/{name}") for name in tables}
    bad = graph.pk_violations({"document": (stored["documents"], "celex"), "chunk": (stored["chunks"], "chunk_id"), "entity": (stored["entities"], "key")})
    if bad.limit(1).count():
        raise ValueError("a primary key of the graph occurs twice")
    return stored


def _review_path(base: str, kind: str) -> str:
    return f"{base}/labeled/{kind}_review"


def pre_review_step(spark: SparkSession, base: str, kind: str, judge: review.Judge | None = None, patience: review.Patience | None = None) -> DataFrame:
    """Labels of a judge for the rows of a stored review table that have none; the table is rewritten in place.

    ``kind`` is 'entities' or 'relations'.  A run that broke off is resumed by calling again.  Returns the rows to
    look at: all that were judged wrong and a share of the right ones.
    """
    path, relations = _review_path(base, kind), kind == "relations"
    rows = materialize(review.pre_review(files.read_review(spark, path, relations), judge, patience), "reviewed")
    files.write_review(rows, path)
    keys = ["chunk_id", "subject", "relation", "object"] if relations else ["chunk_id", "entity_text", "entity_type"]
    return evaluate.spot_check(rows.where(F.col("is_correct").isin("Y", "N")).dropDuplicates(keys), keys)


def finalize_labels(spark: SparkSession, base: str, kind: str, verdicts: DataFrame) -> int:
    """Adjudicated verdicts laid over a stored review table, which is rewritten in place; returns the rows they applied to."""
    path, relations = _review_path(base, kind), kind == "relations"
    keys = ["chunk_id", "subject", "relation", "object"] if relations else ["chunk_id", "entity_text", "entity_type"]
    fields = ["is_correct", "notes"] if relations else ["is_correct", "corrected_type", "notes"]
    done = materialize(evaluate.overlay_verdicts(files.read_review(spark, path, relations), verdicts, keys, fields), "finalized")
    files.write_review(done.drop("applied"), path)
    return done.where("applied").count()


def log_run(spark: SparkSession, base: str, run_id: str, entities: DataFrame, relations: DataFrame, model: str = "rules") -> str:
    """Metrics to the run table, the report as text and the labelled rows as CSV; returns the report."""
    files.log_metrics(evaluate.metrics(entities, relations), run_id, f"{base}/eval_runs", model)
    text = evaluate.report(entities, relations)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/reports/{run_id}")
    for name, df in (("entities", entities), ("relations", relations)):
        files.write_review(df, f"{base}/artifacts/{run_id}/{name}_review")
    return text
