"""SparkSession construction and cluster-aware settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for date bucketing, AQE for
# runtime coalescing and skew splitting, Arrow for the few pandas paths.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tallyfold", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, use the session you are given."""
    b = SparkSession.builder.appName(app)
    for k, v in (extra_conf or {}).items():
        b = b.config(k, v)
    if master:
        b = b.master(master)
    for k, v in CORE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("TALLYFOLD_DRIVER_MEM"):
        b = b.config("spark.driver.memory", os.environ["TALLYFOLD_DRIVER_MEM"])
    elif master and master.startswith("local["):
        b = b.config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there; it is read from
    the session and never replaced.  Only when it is unset on a local master
    (tests) a scratch folder is created; elsewhere that is an error, because
    executors could not read it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tallyfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def size_for_input(spark: SparkSession, paths: list[str], target_bytes: int = 256 << 20,
                   min_partitions: int = 16, max_partitions: int = 200_000) -> int:
    """Size shuffles to the data: about one shuffle partition per
    ``target_bytes`` of input (read from file-system metadata, no data is
    read), with AQE's advisory size and the scan split size set to match, so
    tasks neither spill from oversized partitions nor drown in tiny ones.
    AQE still coalesces partitions that turn out small after filters."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    n = max(min_partitions, min(max_partitions, -(-total // target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return n
