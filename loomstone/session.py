"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Settings that results or plans rest on. Sizes (memory, partitions) are the cluster's to set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "loomstone", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; where the session has none, one of this machine, if all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="loomstone-")


def cut_lineage(df):
    """Write df to the shared checkpoint folder; a folder is set only where the session has none, as in tests."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bare(df):
    """The rows of df without what the optimizer knows of its columns. A checkpoint keeps that, and where one column follows from another (parent from id) each level of a walk
    would put the expression into that of the level before: it doubles at each level until the driver's memory ends."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
