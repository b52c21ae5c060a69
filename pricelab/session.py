"""Session helpers: a sane local session for tests and benches, the shared
checkpoint folder, and unique scratch locations inside it."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pricelab", extra: dict | None = None) -> SparkSession:
    """Local session used by tests, bench and examples.

    On a cluster the caller's own session is used instead; nothing in the
    library depends on these settings except UTC as the session time zone. Where
    a master is set already (a running session, or a submitted application),
    neither it nor the driver's memory is touched.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    conf = dict(_LOCAL_CONF)
    given = SparkConf().get("spark.master") or SparkSession.getActiveSession()
    if master or not given:
        builder = builder.master(master or f"local[{cpus}]")
    else:
        conf.pop("spark.driver.memory")
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; we only create our own
    (a local temporary folder, for tests and local runs) when the session has
    none and runs in local mode -- on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        # a machine-local folder is not reachable by other executors
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="pricelab-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the cluster's file system (driver-side
    metadata call; no data is read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making, if it is there (driver-side metadata call)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files, and the checkpoints where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, of tables that nothing refers to any more.

    Its cleaner hears of them only when the driver's JVM collects garbage, which a job of many small rounds hardly
    makes it do: their files pile up on the executors' disks. (GraphFrames' rounds ask for the same.)"""
    gc.collect()                                                      # Python's handles first: they hold the JVM's
    spark.sparkContext._jvm.System.gc()


def small_frame(spark: SparkSession, rows: list[tuple], schema: str):
    """A DataFrame from a short list of tuples, built from literals in the
    JVM (``createDataFrame`` on a list goes through a Python RDD and starts
    Python workers for every partition). For bounded metadata only: the rows
    become part of the query plan."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
