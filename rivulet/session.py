"""Session helpers: building a local session, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "rivulet") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset a local run gets a temporary folder, which is removed at its end. On a cluster a folder of one
    machine would lose data, so there it is an error.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if given is None and current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="rivulet-checkpoint-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
    if current is None:
        sc.setCheckpointDir(given)
    return given or current


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder for what one run writes; forget() removes all of them."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def forget(spark: SparkSession) -> None:
    """Remove the folders that this process got from scratch(). DataFrames that read them are of no use afterwards."""
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written copy, which survives the loss of any executor.

    The copy is removed with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
