"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "aislewise", conf: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the local bench. On a cluster, build the session with
    the cluster's own settings instead; every operator works with any session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Many distinct plans run in one session; keep their generated classes compiled.
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config("spark.driver.memory", "8g")
        .config(map=conf or {})
        .getOrCreate()
    )


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session (which has none)."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect raises: no JVM context on the client
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set, to storage that the driver and all executors share (that can be
    a ``file:`` path if it is mounted everywhere, which the library cannot tell). Only when it is
    unset and the master is local (tests) a scratch folder is made, and kept as the context's
    checkpoint folder, so that a session uses one.
    """
    sc = _context(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if sc is None or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (executors write checkpoints there)")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="aislewise-ckpt-"))
        configured = sc.getCheckpointDir()
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A path to write to, in a new folder below the checkpoint folder that is deleted when the
    session's JVM ends."""
    folder = "/".join([checkpoint_dir(spark).rstrip("/"), kind, uuid.uuid4().hex])
    sc = _context(spark)
    if sc is not None:  # Spark Connect has no JVM here; its server's own cleaning applies
        place = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)  # does nothing for a folder that does not exist yet
    return f"{folder}/data"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back, cutting its lineage.

    Used for small derived tables (one row per device, say) that a plan reads more than once;
    Spark would otherwise recompute them from the raw rows for every reference.
    """
    path = scratch_path(df.sparkSession, "materialized")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # known schema: no footer read
