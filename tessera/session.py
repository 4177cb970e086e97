"""Session and checkpoint-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tessera", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; set a private one only for an unset local run."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_A_TASK = 200_000  #: rows of a settled table below which tasks are joined


def settled(df: DataFrame) -> DataFrame:
    """As ``cut`` for tables of narrow rows (ids and links): small ones come back in as few partitions as their rows need."""
    done = cut(df)
    rows, parts = done.count(), done.rdd.getNumPartitions()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return done.coalesce(wanted) if wanted < parts else done


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if the session still lives."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut_table(df: DataFrame) -> DataFrame:
    """As ``cut`` for large narrow rows: a compressed Parquet table in the same folder, removed when the program ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)
