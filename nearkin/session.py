"""Session construction and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "nearkin", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for.

    ``cores`` selects a local master; leave it unset under ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local master may fall back to a temporary folder: on a cluster the executors would
    not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="nearkin-")
    return _local_dir


_local_dir: str | None = None


def peak_memory(spark: SparkSession) -> int:
    """Largest heap in bytes that any of the application's processes has reported; of the driver's now if none has."""
    processes = spark._jsc.sc().statusStore().executorList(True)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    peaks = [runtime.totalMemory() - runtime.freeMemory()]
    for i in range(processes.size()):
        metrics = processes.apply(i).peakMemoryMetrics()
        if metrics.isDefined():
            peaks.append(metrics.get().getMetricValue("JVMHeapMemory"))
    return max(peaks)


# Symbols that one task takes apart.
TASK_SYMBOLS = 1 << 22


def spread(df: DataFrame, text: str) -> DataFrame:
    """The rows over as many tasks as the symbols of ``text`` need, where that is more than the session's cores.

    A small compressed file is read by few tasks, whatever its strings are taken apart into.
    """
    symbols = df.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = -(-symbols // TASK_SYMBOLS)
    return df.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


# Frees the shuffle files of a query as soon as its output is written.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and return it as a scan.

    Used where several branches of a plan read the same rows or where an iteration has to drop
    its lineage. The copy survives the loss of executors, later scans prune its columns, and
    its known file size lets Spark pick broadcast or shuffle joins. The shuffle files behind it
    are freed once it is written. ``discard`` deletes a copy that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
