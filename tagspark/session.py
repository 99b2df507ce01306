"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # No call site per Column: long expressions are built faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings this library is tuned for."""
    builder = SparkSession.builder.appName("tagspark")
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


# Folders of local sessions that name none, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one `spark.checkpoint.dir` names.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    run = spark.sparkContext.applicationId
    if run not in _LOCAL_DIRS:
        _LOCAL_DIRS[run] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[run]


def fresh_path(spark: SparkSession, name: str) -> str:
    run = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tagspark/{run}/{name}-{uuid.uuid4().hex}"


def clear_written(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call when its results have been read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tagspark/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several branches of a plan read one costly table, which Spark
    would compute once per branch, and where a step must not run twice because
    it is expensive or not deterministic. The table survives lost executors and
    ends the lineage. All tables of one application share a folder, which can
    be deleted when its results have been read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
