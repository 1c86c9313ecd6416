"""Session set-up and the places where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A batch is held by the executor and by its worker at once: of Spark's own 10,000 rows, tens of MB of texts in each task.
BATCHES, SPARKS_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 1000


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, benches and the command line; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("netloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of BATCH_ROWS rows, unless the session asks for another number than Spark's own."""
    if spark.conf.get(BATCHES) == SPARKS_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, an error on a cluster."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="netloom-"))
        found = context.getCheckpointDir()
    return found


#: Whether shuffle files go with the query that made them; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The rows survive the loss of any executor, the lineage ends here, and the
    next read prunes columns, which a row-wise checkpoint could not.  With
    ``by`` each value of that column has a folder of its own, so that a filter
    on it reads nothing else.  What was shuffled for it is deleted when it is
    written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that nothing reads any more; other frames are left alone."""
    for df in cuts:
        path = getattr(df, "cut_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
