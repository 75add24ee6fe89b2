"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs only the
tasks it ran.  Where a local session has no such folder (tests), one is set once; on a cluster a missing
folder raises, since a machine-local one would not be seen by the others.  Tables that a returned
DataFrame still reads stay; ``clear`` removes all of an application once its results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; set to a fresh local folder only where it is unset and the master is local."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandmill/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables that ``save`` returned and that no later read needs."""
    for table in tables:
        drop_path(table.sparkSession, table.saved_at)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application saved; call it when its results are written."""
    drop_path(spark, _home(spark))
