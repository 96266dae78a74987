"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skeinlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset a
    session on one machine (master local[...], as in tests) gets a temporary folder; on
    a cluster that is an error, as no machine's own folder is seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(context, "_skeinlake_dir", None)
        if not found:
            folder = tempfile.mkdtemp(prefix="skeinlake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = "file://" + folder
            context._skeinlake_dir = found
    return found


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, keeps
    the result of a costly stage for several readers, survives lost executors.
    The folder is removed when the session's JVM ends, or by `discard`."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._skeinlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what `materialize` wrote for df, once nothing will read it again."""
    files, where = _file_system(df.sparkSession, df._skeinlake_path)
    files.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly to at least as many tasks as there are cores, for scans whose
    rows cost far more in Python than their shuffle does: splits of a file follow its
    row groups, which say nothing of that work.  The same plan at every size."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
