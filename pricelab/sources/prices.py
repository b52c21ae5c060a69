"""Price-table sources.

The reference reads a CSV in 100k-row chunks and concatenates them; Spark
splits files natively, so a scan is one lazy ``FileScan`` over any number of
files, and a "union of chunks" is a multi-path read or ``unionByName``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.functions.names import clean_names as _clean_names
from pricelab.session import path_exists


def scan_prices(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
                clean: bool = True, fmt: str = "csv", **options) -> DataFrame:
    """Scan price files with a header.

    Pass ``schema`` in production (inference costs an extra pass over the
    data); without it types are inferred. A missing path raises. Column names
    are cleaned (P1) unless ``clean=False``. NaN is read as missing (NULL).
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = nan_to_null(reader.load(path))
    return _clean_names(df) if clean else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, so statistics skip it."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def peek(df: DataFrame, n: int = 5) -> tuple[list[str], list]:
    """Column list and the first ``n`` rows (S2); reads only what ``n`` needs."""
    return df.columns, df.limit(n).collect()


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length) of the files under ``path``.

    ``binaryFile`` without its ``content`` column reads file metadata only.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
            .select("path", "modificationTime", "length"))


def latest_file(spark: SparkSession, path: str, glob: str = "*") -> str:
    """Path of the most recently modified file; the file name breaks mtime
    ties (run-stamped names sort by time)."""
    files = list_files(spark, path, glob)
    best = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).collect()[0]["m"]
    if best is None:
        raise FileNotFoundError(f"no files matching {glob!r} under {path}")
    return best["path"]


def scan_latest(spark: SparkSession, path: str, glob: str = "*", fmt: str = "parquet",
                schema=None, **options) -> DataFrame:
    """Scan only the latest file of a folder (S3). One driver-side value (a
    path) is fetched; the file itself is read by the executors."""
    p = latest_file(spark, path, glob)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(p)


def latest_run(spark: SparkSession, base: str, glob: str = "*") -> str:
    """Folder of the most recent run under ``base`` (S3 for multi-file runs).

    A run is a folder ``run=...`` that holds ``_SUCCESS``, with all its files at
    any depth (partition folders included); unfinished runs don't count. The
    run's time is its newest file's modification time and the folder name (a
    run stamp) breaks ties. The listing is aggregated by Spark; folders come back
    one after the other, newest first, until a finished one.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(base).select("path", "modificationTime"))
    folder = F.regexp_extract("path", r"^(.*/run=[^/]*)/", 1)
    runs = (files.groupBy(folder.alias("folder")).agg(F.max("modificationTime").alias("mtime"))
            .where(F.col("folder") != ""))
    # newest first, until one is finished
    for r in runs.orderBy(F.col("mtime").desc(), F.col("folder").desc()).toLocalIterator():
        if path_exists(spark, f"{r['folder']}/_SUCCESS"):
            return r["folder"]
    raise FileNotFoundError(f"no files matching {glob!r} under {base}")


def union_prices(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union of chunks of one schema, matched by name (U1). A chunk without one
    of the columns raises, or gives NULLs there with ``allow_missing``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def scan_chunks(spark: SparkSession, paths: list[str], schema=None, fmt: str = "csv") -> DataFrame:
    """Union of chunk files as ONE multi-path scan: the planner sees a single
    file source (one plan node however many chunks), splits files natively,
    and pushes filters and column pruning into every chunk."""
    return scan_prices(spark, paths, schema=schema, fmt=fmt)
