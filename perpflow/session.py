"""Session settings every perpflow job relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "perpflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the call site of every column costs several calls into the JVM each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All market timestamps are UTC instants; make the session agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; every executor can reach it.

    A local session that names none (a laptop, a unit test) gets a scratch folder. A cluster
    session without the setting is refused: a folder of this machine would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = named or tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several later branches read to the shared folder and read it back.

    Compared with ``checkpoint()`` the result is computed once, and the table that comes back
    has statistics and prunes columns.
    """
    path = f"{shared_folder(df.sparkSession)}/perpflow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def weighed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys of a join that follows.

    The planner judges a written table by its compressed files and exploded rows by what they came from, and would
    broadcast through the driver what is many times larger. Dealt rows are judged by what they weigh.
    """
    return df.repartition(*keys)


def drop_written(df: DataFrame) -> None:
    """Remove the table behind a result of ``cut_lineage`` once no later step reads it."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/perpflow-" not in file or folder.rpartition("/")[2] not in file:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
