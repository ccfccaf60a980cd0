"""Sessions, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def local_session(app: str = "ridgeline", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster use the one that is there."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on one machine, where it is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="ridgeline-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system layer; a session that has ended is left alone."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is gone: nothing can be deleted any more
        pass


_SETTLED: dict[int, tuple[weakref.ref, str]] = {}


def settled(df: DataFrame, tag: str = "settled") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Lost executors then recompute nothing that came before, iterations start from
    files instead of a growing lineage, and values that depend on partitioning
    are fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _SETTLED[id(out)] = weakref.ref(out), path
    return out


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a settled table's files, once nothing reads it any more."""
    known, path = _SETTLED.pop(id(df), (lambda: None, ""))
    if known() is df:
        delete(spark, path)
