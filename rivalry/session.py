"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Defaults that hold at any scale: AQE re-plans joins and partition counts at
# runtime from real sizes, splits skewed join partitions, and the broadcast
# threshold is the only way a data-dependent side becomes a broadcast.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once nothing refers to them (long sessions)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "rivalry",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or fetch) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``spark.sql.shuffle.partitions`` to the input (about 128 MB per task).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a Spark Connect session (the server then
    takes the folder from ``spark.checkpoint.dir``)."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect has no driver-side context
        return None


def configured_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the
    context), None where there is none."""
    sc = _context(spark)
    if sc is None:
        return spark.conf.get("spark.checkpoint.dir", None)
    return (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
            or sc.getConf().get("spark.checkpoint.dir"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; an error where none is configured.  The
    library never invents a folder: on a cluster it must be shared storage
    that every executor can reach."""
    conf_dir = configured_dir(spark)
    if not conf_dir:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    sc = _context(spark)
    if sc is None:
        return conf_dir
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """One fixed copy of ``df`` for several readers.

    With a shared checkpoint folder it is written there and its lineage is
    cut, so a lost executor costs nothing.  Without one it is kept by the
    executors; what is lost is computed again from the same lineage - the same
    tasks, the same range bounds - so readers still see one result.
    """
    if configured_dir(df.sparkSession):
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stored(df: DataFrame) -> DataFrame:
    """:func:`materialize` for wide stages: a columnar copy in the shared folder,
    so that a reader takes only its columns and a join knows the copy's size.
    The copy stays as long as the folder: not for loops."""
    spark = df.sparkSession
    if not configured_dir(spark):
        return materialize(df)
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").orc(path)
    return spark.read.schema(df.schema).orc(path)
