"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "kvlake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, the command line and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session. Where that is unset, a session on one
    machine (tests, the bench) gets a temporary folder; a cluster raises ValueError."""
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():  # set for this session
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for what a query writes; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/kvlake-{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written_once(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and read from the shared folder from then on, also after executors are lost."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
