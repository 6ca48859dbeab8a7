"""Source-file manifest (S4) and latest-N selection.

The manifest is a ``binaryFile`` listing restricted to path, length and
modification time: Spark prunes the ``content`` column from the read
schema, so listing touches metadata only. Paths may be folders or globs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST_SCHEMA = "path string, file_name string, length long, modified timestamp"

# a file whose base name contains this (any case) is an error log, not sensor data
ERROR_FILE_PATTERN = "(?i)error"


def base_name(path_col) -> F.Column:
    return F.element_at(F.split(path_col, "/"), -1)


def file_manifest(spark: SparkSession, source: str | list[str], glob: str = "*.csv") -> DataFrame:
    """path, file_name, length, modified for files matching ``glob``.

    A missing folder gives an empty manifest.
    """
    paths = [source] if isinstance(source, str) else list(source)
    try:
        df = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
              .select("path", base_name(F.col("path")).alias("file_name"), "length",
                      F.col("modificationTime").alias("modified")))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], MANIFEST_SCHEMA)
        raise
    return df


def sensor_files(manifest: DataFrame) -> DataFrame:
    """Keep files whose base name does not contain "error" (case-insensitive)."""
    return manifest.where(~F.col("file_name").rlike(ERROR_FILE_PATTERN))


def latest_files(manifest: DataFrame, n: int = 2) -> DataFrame:
    """The n most recently modified files (ties by path); a top-n report."""
    return manifest.orderBy(F.desc("modified"), F.asc("path")).limit(n)


def sensor_file_info(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """One row: sensor_file_count, sensor_files (sorted names)."""
    m = sensor_files(file_manifest(spark, source))
    return m.agg(F.count(F.lit(1)).alias("sensor_file_count"),
                 F.coalesce(F.sort_array(F.collect_list("file_name")), F.array().cast("array<string>"))
                 .alias("sensor_files"))


def select_latest_sensor_files(spark: SparkSession, source: str | list[str], n: int = 2) -> tuple[DataFrame, list[str]]:
    """S5 with distinct errors for a missing folder and for a folder without sensor files."""
    from qforge.session import path_exists
    for src in ([source] if isinstance(source, str) else source):
        if not path_exists(spark, src):
            raise FileNotFoundError(f"data folder not found: {src}")
    m = sensor_files(file_manifest(spark, source))
    chosen = [r["path"] for r in latest_files(m, n).select("path").collect()]
    if not chosen:
        raise ValueError(f"no sensor CSV files under {source}")
    return m, chosen
