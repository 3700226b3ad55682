"""Incremental extraction as a stream: new chunks are extracted once, results appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.operators.extract import Backend, RuleBackend, pending, run
from kgspark.sources.files import stored


def resume_stream(
    spark: SparkSession, chunk_path: str, result_path: str, failure_path: str, state_path: str,
    backend: Backend | None = None, timeout: float | None = None,
) -> None:
    """Process every chunk file that arrived since the last call (``availableNow``), then stop.

    The stream's checkpoint remembers the files, the batch id names the output folder: a batch that is
    repeated after a failure overwrites its own folder, and chunks with a result of an earlier batch are left
    out, so nothing is extracted or appended twice.  Failed chunks go to the failure table and can be run again
    with another backend.
    """
    model = backend or RuleBackend()
    source = spark.readStream.schema(schemas.CHUNKS).json(chunk_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.groupBy("chunk_id").agg(F.max("text").alias("text"))
        earlier = stored(spark, result_path)
        if earlier is not None:  # a chunk may come again in another file; its own batch, if repeated, does not count
            once = pending(once, earlier.where(F.col("batch") != batch_id))
        out = run(once, model, timeout)
        out.persist()
        out.where("status = 'ok'").write.mode("overwrite").parquet(f"{result_path}/batch={batch_id}")
        out.where("status <> 'ok'").write.mode("overwrite").parquet(f"{failure_path}/batch={batch_id}")
        out.unpersist()

    query = source.writeStream.foreachBatch(write).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
