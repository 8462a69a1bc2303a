"""Session helpers.

The library never owns the session on a cluster: every function takes the
``SparkSession`` (or a DataFrame) it is given.  ``local_session`` exists for
tests and ``bench.py`` only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on for scale.  AQE coalesces small shuffle
# partitions and splits skewed ones; partial (map-side) aggregation is Spark's
# default for every groupBy used here.  ``percentile`` keeps one object per
# group: the default of 128 groups a task would make nearly every detail task
# fall back to sorting.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}

#: Scratch folders of local sessions that name none, by application.
_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lotlens") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no ports beyond Spark's own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # PySpark's per-Column call-site capture costs JVM round trips while
        # plans are built; off for our own test/bench sessions only.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lotlens-shared-"))
    )
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` (or
    the context's checkpoint folder) names it.  Nothing the caller set is changed.

    With neither, a local session gets a scratch folder of its own; on a
    cluster there is no safe guess, and the caller has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder outside the executors' own")
    return _LOCAL_SCRATCH.setdefault(context.applicationId, tempfile.mkdtemp(prefix="lotlens-shared-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
