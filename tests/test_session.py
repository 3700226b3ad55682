"""Who launches the driver decides; the shared folder is asked for on a cluster."""

import os
import subprocess
import sys

import pytest

from kgspark import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "from kgspark.session import build_session as b; s = b('local[8]', 'x', {'spark.sql.shuffle.partitions': '9'}); print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.session.timeZone'))"


def launched(args):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": ROOT} | ({"PYSPARK_SUBMIT_ARGS": args} if args else {})
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120).stdout
    return next(x for x in out.splitlines() if x.startswith("GOT")).split()[1:]


def test_submitter_wins():
    assert launched("--master local[2] --conf spark.sql.shuffle.partitions=5 --conf spark.ui.enabled=false pyspark-shell") == ["local[2]", "5", "UTC"]


def test_defaults_without_a_submitter():
    assert launched("") == ["local[8]", "9", "UTC"]


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Fake)
