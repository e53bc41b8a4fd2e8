"""Spark session settings for the activity jobs.

The jobs are plain DataFrame plans; what they need from the session is AQE
(runtime coalescing, skew-join splitting, broadcast conversion from measured
sizes), a UTC session time zone (all timestamps are TIMESTAMP_NTZ wall-clock
values, but literals and casts must not drift) and a reliable checkpoint
directory for lineage cuts in multi-output jobs.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime SQL settings applied to any session the jobs run in (including a
# session created by someone else). Shuffle partition count is *not* forced
# here: on a cluster it is sized by the operator of the cluster; AQE coalesces
# small partitions and splits skewed ones at run time.
RUNTIME_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the jobs rely on; returns ``spark``."""
    for key, value in RUNTIME_SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "worklens") -> SparkSession:
    """A local-mode session for tests and the bench (no UI, no ports beyond Spark's own)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("WORKLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Python call-site capture costs several JVM round trips per column
        # function while a plan is built; batch jobs do not need it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's own folder in storage that all executors share.

    One rule for every master: the folder that ``spark.checkpoint.dir`` names,
    or, where it is unset (tests), one under the session's warehouse, which a
    cluster shares too. The folder is removed when the driver's JVM ends.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/worklens-checkpoints")
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc.getCheckpointDir()
