"""Session settings the engine counts on, and the shared folder for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Skewed partitions are split at run time, small ones merged, and a side is broadcast only when
# Spark knows its size to be under the session's threshold: no plan of the engine sets a hint.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", name: str = "caseflow", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **ENGINE_CONF,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the session names, if any; made current if it is not yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is not None:
            context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later plans start from it.

    Where the session names no such folder ``df`` comes back as it is, and later plans compute it
    again.
    """
    return df if checkpoint_folder(df.sparkSession) is None else df.checkpoint()
