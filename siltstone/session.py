"""Session helpers: building a session and cutting lineage in storage that all executors share."""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE); ``conf`` uses ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them any more
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only where none is set (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if named:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"siltstone-{os.getuid()}"))
    return jsc.getCheckpointDir().get()


class Stages:
    """Results of a pipeline's stages in a folder, so that a run that was broken off goes on where it was.

    ``stages(name, df)`` writes ``df`` once as parquet and gives what was written; a stage that is complete (Spark's _SUCCESS
    mark) is read instead. Without a folder stages are checkpoints and nothing is kept."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder

    def done(self, name: str) -> bool:
        return self.folder is not None and exists(self.spark, f"{self.folder}/{name}/_SUCCESS")

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        if self.folder is None:
            return materialise(df)
        path = f"{self.folder}/{name}"
        if not self.done(name):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def configure_logging(level: str | int = "INFO") -> None:
    """Times and levels on standard error; Spark's own Python bridge only from warnings on."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there: lineage is cut, executor loss is survived."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least_mb: int = 1) -> DataFrame:
    """``df`` over all cores where it is so small that the scan would leave most of them idle (less than ``least_mb`` MB a
    core by the planner's estimate, which costs no job); any larger input goes on as it is, without a shuffle. Rows are the
    same either way. This is for tables of a few files or row groups, where a scan can't be cut any finer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < size < cores * least_mb * (1 << 20) else df
