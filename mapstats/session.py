"""Session helpers for local runs; on a cluster the caller brings its own session."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "mapstats", cores: int | str = 8, shuffle_partitions: int = 8, checkpoint_dir: str | None = None, memory: str = "6g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def workspace(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names for checkpoints; a local one where none is named."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        base = tempfile.mkdtemp(prefix="mapstats-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in a fixed number of partitions, for work that is long beside the bytes it reads: partitions that are small in bytes
    would else be merged into a few tasks."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def materialised(df: DataFrame) -> DataFrame:
    """Cut lineage: write below the workspace and read again. The files go when the driver ends."""
    spark = df.sparkSession
    path = workspace(spark)
    df.write.parquet(path)
    atexit.register(_discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _discard(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session or its gateway has ended
        return
