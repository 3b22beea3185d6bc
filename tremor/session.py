"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}
#: Folder of a local application that names none.
_OWN: dict[str, str] = {}


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tremor")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:  # the setting itself can't be changed in a running session
        _OWN[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage durably (a lost executor re-reads files) and gives the next
    plan real size statistics, so AQE can pick broadcast joins on its own.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build()`` once per application and input folder, then reuse its table."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}|{name}")
    if key not in _STAGED:
        df = build()
        path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
        df.write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def forget_staged() -> None:
    """Let the next query stage its tables anew, as after a change of the input under the same path."""
    _STAGED.clear()
