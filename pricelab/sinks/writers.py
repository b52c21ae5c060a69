"""Sinks (K1-K3): clean table, run-stamped predictions and metrics.

All writes are whole-table distributed writes; nothing passes through the
driver. Paths should live on shared storage.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from pricelab.session import path_exists, remove_path

#: Rows of a file at most; a partition of the clean table has as many files as its rows need.
FILE_ROWS = 5_000_000
#: The file that names the current version of a published table, and how many versions stay for running readers.
POINTER = "_current.json"
VERSIONS = 2


def run_stamp(now: datetime | None = None) -> str:
    # fixed format of run names
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def _partitioned(df: DataFrame, fmt: str, partition_by: list[str] | None, file_rows: int):
    """(writer, partition columns): rows are dealt by partition and, where one is large, over as many tasks as its size
    asks for (a rebalancing shuffle under adaptive execution), so neither tasks nor files grow with a partition."""
    parts = partition_by if partition_by is not None else [c for c in ("year", "month") if c in df.columns]
    w = (df.hint("rebalance", *parts) if parts else df).write.format(fmt).option("maxRecordsPerFile", file_rows)
    if fmt == "csv":
        w = w.option("header", "true")
    return w.partitionBy(*parts) if parts else w


def write_clean(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, file_rows: int = FILE_ROWS) -> None:
    """Overwrite the clean table (K1); partitioned by year/month when present. Readers of ``path`` can see it
    half written: see :func:`publish`."""
    _partitioned(df, fmt, partition_by, file_rows).mode("overwrite").save(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, base: str) -> dict:
    path = f"{base.rstrip('/')}/{POINTER}"
    if not path_exists(spark, path):
        return {"versions": []}
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write_pointer(spark: SparkSession, base: str, content: dict) -> None:
    """Replace the pointer in one step: written beside it, then moved over it."""
    jvm = spark.sparkContext._jvm
    staged, fs = _file_system(spark, f"{base.rstrip('/')}/_{uuid.uuid4().hex}.json")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    final, _ = _file_system(spark, f"{base.rstrip('/')}/{POINTER}")
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(final), modes)


def publish(df: DataFrame, base: str, partition_by: list[str] | None = None, file_rows: int = FILE_ROWS, keep: int = VERSIONS) -> str:
    """Write a whole new version of the table under ``base`` and then point to it (K1, atomically for readers).

    A version is a folder of its own; until the pointer moves, readers see the one before, and a failed write leaves
    nothing but an unnamed folder. The last ``keep`` versions stay, so a reader that has begun can end. One writer at
    a time. Returns the version's folder."""
    spark = df.sparkSession
    version = f"version={run_stamp()}-{uuid.uuid4().hex[:8]}"
    folder = f"{base.rstrip('/')}/{version}"
    _partitioned(df, "parquet", partition_by, file_rows).mode("errorifexists").save(folder)
    versions = [*_read_pointer(spark, base)["versions"], version]
    _write_pointer(spark, base, {"current": version, "versions": versions[-keep:]})
    for old in versions[:-keep]:
        remove_path(spark, f"{base.rstrip('/')}/{old}")
    return folder


def current_version(spark: SparkSession, base: str) -> str:
    """Folder of the published table's current version (one small file is read; nothing is listed)."""
    pointer = _read_pointer(spark, base)
    if "current" not in pointer:
        raise FileNotFoundError(f"nothing is published under {base}")
    return f"{base.rstrip('/')}/{pointer['current']}"


def read_published(spark: SparkSession, base: str) -> DataFrame:
    """The published table: the version that is current now, whole, whatever is published later."""
    return spark.read.parquet(current_version(spark, base))


def write_run(df: DataFrame, base: str, stamp: str | None = None, fmt: str = "parquet") -> str:
    """Write under ``{base}/run={stamp}`` (K2); returns the folder."""
    out = f"{base.rstrip('/')}/run={stamp or run_stamp()}"
    w = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(out)
    return out


def append_metrics(metrics_long: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add a metric table under its run id (K3): one folder per run, so writing
    a run again replaces its rows and leaves the others'."""
    metrics_long.drop("run_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id or run_stamp()}")
