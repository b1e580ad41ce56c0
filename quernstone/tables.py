"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder of our own in local mode (tests), and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing else uses."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many folders were made so far; what release() starts from."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, *kept: DataFrame) -> None:
    """Deletes the folders made since then, but those that the kept DataFrames read. Others that read them can't be used any more."""
    needed = [f for df in kept for f in df.inputFiles()]
    gone = [path for path in _made[since:] if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in needed)]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove(path)


#: Shuffle files of a query go when it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its rows are fixed, and no lost executor takes them along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
