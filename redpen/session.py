"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", app: str = "redpen", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is taken, but only in local mode:
    on a cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="redpen-")
    return _local_dirs[sc.applicationId]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/redpen-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder, which goes when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _cleaned:
        _cleaned.add(application)
        atexit.register(_clear_at_exit, application)
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables that this application staged; frames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(application: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark and spark.sparkContext.applicationId == application:
        clear_staged(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read, so that its kernel runs once.

    The written table also survives lost executors, and readers prune its columns. The shuffles
    behind it go as soon as it is written; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
