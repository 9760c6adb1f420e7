"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 1 << 17

# Settings every riskframe job relies on. ANSI mode stays on: operators use
# try_divide / try_cast / nullif wherever a value can be undefined.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "riskframe",
                shuffle_partitions: int | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the riskframe defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count then comes from the cluster configuration.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, read from the session.

    Streams, sinks and written intermediate tables go there, so every
    executor must see it. Where it is unset, a single-machine session
    (``local[...]``, as in tests) gets a folder of its own; any other raises,
    because a machine-local folder would lose data on a cluster.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskframe-"))
    return sc.getCheckpointDir()


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def dealt(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, a table whose rows are cheap to count, dealt evenly over tasks of at most about ``rows_per_task``
    rows, and over every core: a well packed file of few bytes is otherwise read by one task, however many rows it has."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows_per_task))
    return df.repartition(tasks)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the
    lineage and fixes generated values; a lost executor costs a re-read."""
    path = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
