"""Session defaults, the shared checkpoint folder and materialised stages.

Stages that feed more than one consumer (or close an iteration) are written as Parquet tables below the
folder named by ``spark.checkpoint.dir``.  On a cluster that folder is shared by all executors, so a lost
executor never loses a stage.  Only where the setting is missing (tests, a laptop) a folder is chosen here.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def _submitted() -> dict[str, str]:
    """Settings made by whoever launched the driver: a submit command, an environment or a context that runs already."""
    if SparkContext._jvm is None and not {"PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR"} & os.environ.keys():
        return {}
    SparkContext._ensure_initialized()
    own = SparkContext._active_spark_context
    return dict((own.getConf() if own else SparkConf()).getAll())


def build_session(master: str = "local[8]", app: str = "kgspark", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's defaults; the master and all settings of the submitter win over those given here."""
    given = _submitted()
    builder = SparkSession.builder
    for k, v in (DEFAULTS | {"spark.master": master, "spark.app.name": app} | (conf or {})).items():
        if k not in given:
            builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, read from the session; a local one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kgspark-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_local, found)
    return found.rstrip("/")


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


_RUN = f"kgspark-{os.getpid()}-{uuid.uuid4().hex[:8]}"
_stages: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and survives executor loss."""
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/{_RUN}"
    if run not in _stages:
        _stages[run] = spark
        atexit.register(drop_stages)
    path = f"{run}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of a stage that nothing will read again, so that an iteration's disk does not grow with its rounds."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, task_bytes: int = 64 << 20) -> int:
    """Tasks for a sort or shuffle of ``df``: what the session says, or more where the optimizer's size of it asks for more."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // task_bytes, 1_000_000))


def drop_stages() -> None:
    """Delete the stages of this process; results that still read from them must have been written before."""
    for run, spark in list(_stages.items()):
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(run)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
        _stages.pop(run, None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder: ``<dir>/<name>.parquet`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores where its input has fewer splits than there are cores (a few small files).

    Inputs with enough splits pass unchanged, so nothing is shuffled at scale; so does anything behind an
    exchange, whose partitions are not known before it has run.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per context, so that no node needs it installed."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_kgspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kgspark-code-")  # on the driver only; the driver serves the file
    atexit.register(_remove_local, folder)
    path = os.path.join(folder, "kgspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._kgspark_shipped = True
