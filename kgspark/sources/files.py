"""Readers and writers of the pipeline's files: JSON documents, JSON arrays, JSON lines, CSV reviews, page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.session import materialize


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one multi-line JSON object per file."""
    return spark.read.schema(schemas.PARSED).option("multiLine", True).json(path)


def read_chunk_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, one JSON array of objects per file."""
    return spark.read.schema(schemas.CHUNKS).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records with ``seq``, the order of their lines.

    A line number needs the whole file in one task, so the ordinal is (file, byte order within the split):
    ``seq`` is unique and increases with the place of the line within each file.
    """
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("seq"), "value")
    parsed = F.from_json("value", "chunk_id string, entities array<struct<text:string,type:string>>, relations array<struct<subject:string,relation:string,object:string>>", {"mode": "PERMISSIVE"})
    return raw.select("seq", parsed.alias("r")).select("seq", "r.chunk_id", "r.entities", "r.relations")


def read_review(spark: SparkSession, path: str, relations: bool = False) -> DataFrame:
    """Review CSV: header, all strings, quoted texts over several lines; ``is_correct(Y/N)`` becomes ``is_correct``."""
    schema = schemas.RELATION_REVIEW if relations else schemas.ENTITY_REVIEW
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_pages(spark: SparkSession, path: str, to_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(celex, page, text) of binary documents ``<celex>/document.pdf`` through a page-text backend."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("celex"), "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, i, t) for c, b in zip(pdf["celex"], pdf["content"], strict=True) for i, t in enumerate(to_pages(bytes(b)))]
            yield pd.DataFrame(rows, columns=["celex", "page", "text"])

    return named.mapInPandas(pages, schemas.PAGES)


def registry_status(registry: DataFrame, found: DataFrame) -> DataFrame:
    """(celex, downloaded) for every registered act."""
    f = found.select("celex").distinct().withColumn("_f", F.lit(True))
    return registry.select("celex").distinct().join(f, "celex", "left").select("celex", F.coalesce("_f", F.lit(False)).alias("downloaded"))


def document_url(celex: str = "celex", template: str = "https://example.org/legal-content/%s/PDF") -> Column:
    """Address of an act's document from a template with one place for the id."""
    return F.format_string(template, F.col(celex))


def missing_sidecars(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """Sidecar rows (celex, title, pdf_url) of acts that have none yet: insert if absent."""
    return registry.join(existing.select("celex").distinct(), "celex", "left_anti").select("celex", "title", document_url().alias("pdf_url"))


def write_partitioned(df: DataFrame, path: str, by: str = "celex", fmt: str = "parquet") -> None:
    """Overwrite, one folder per value of ``by``; rows are gathered by it first so that folders hold few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None while nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_arrays(df: DataFrame, path: str, by: str = "celex") -> None:
    """One JSON array of objects per value of ``by``, in folders named by it; for samples, whose groups are small."""
    cols = [c for c in df.columns if c != by]
    one = df.groupBy(by).agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value"))
    one.write.mode("overwrite").partitionBy(by).text(path)


def write_sidecars(spark: SparkSession, registry: DataFrame, path: str) -> DataFrame:
    """Sidecar rows of acts that have none yet are appended as JSON lines, one folder per act; returns those added."""
    try:
        existing = spark.read.schema("celex string").json(path)
    except AnalysisException:
        existing = spark.createDataFrame([], "celex string")
    new = materialize(missing_sidecars(registry, existing).dropDuplicates(["celex"]), "sidecars")
    new.withColumn("folder", F.col("celex")).write.mode("append").partitionBy("folder").json(path)
    return new


def append_results(df: DataFrame, path: str) -> None:
    """Durable append; a task's rows become visible with its commit."""
    df.write.mode("append").parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    """Review CSV with header; the label column carries its published name."""
    df.withColumnRenamed("is_correct", "is_correct(Y/N)").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Rewrite a table that ``df`` reads from: write beside it, then exchange the folders."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, new, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", "._new", "._old"))
    df.write.mode("overwrite").parquet(path + "._new")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def log_metrics(metrics: DataFrame, run_id: str, path: str, model: str = "rules") -> None:
    """Append (run_id, model, metric, value)."""
    metrics.select(F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), "metric", "value").write.mode("append").parquet(path)
