"""Tables and folders that every executor can reach.

Lineage is cut by writing to the folder named in ``spark.checkpoint.dir`` (set
by the cluster); executors may be lost at any time and the files stay readable.
Only on a local master without that setting, as in tests, a temporary folder is made.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from colmatch.functions.types import InvalidConfig

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores; unchanged if it has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session as a URI or path."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise InvalidConfig("spark.checkpoint.dir must name a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="colmatch-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder; removed when Python ends."""
    path = f"{shared_root(spark)}/colmatch-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    if path.startswith("file:"):
        shutil.rmtree(path[len("file:"):].replace("//", "/", 1), ignore_errors=True)
        return
    spark = SparkSession.getActiveSession()
    if spark is None:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be going down
        pass
