"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "saddlespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; any setting can be overridden by name."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it; it goes when the session ends.

    That is the folder Spark made for this application below ``spark.checkpoint.dir``.  Only a
    local session without the setting gets one next to its tables; on a cluster a missing
    setting is an error, because a machine-local folder would be lost together with its
    executor.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        sc.setCheckpointDir(folder)
    folder = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a re-computation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
