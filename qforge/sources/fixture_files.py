"""Sensor CSV files derived from the driver's tables, for the ingest queries.

Every row of ``sensor_raw`` lands in exactly one variant (by event_id
mod 5); each variant exercises one ingest rule. Files are written by
Spark's CSV writer (in parallel) into a unique folder below the shared
checkpoint folder, then given stable names and modification times with
Hadoop FileSystem metadata calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.session import scratch_path
from qforge.sources import testdata as td

KOREAN = {"temp": "온도", "humid": "습도", "press": "압력", "error": "불량여부"}
NOTE_TEXT = "뷁 비고"


@dataclass(frozen=True)
class Variant:
    name: str
    residue: int | None       # event_id % 5 that goes here; None = no rows
    charset: str              # JVM charset for the writer
    headers: dict             # canonical name -> header text
    null_token: str
    note: bool = False        # add a string column only this file has
    mtime_rank: int = 0


VARIANTS = [
    Variant("a", 0, "UTF-8", dict(KOREAN, event_id="event_id"), "", mtime_rank=1),
    Variant("b", 1, "UTF-8", dict(KOREAN, event_id="\ufeffevent_id"), "NA", mtime_rank=2),
    Variant("c", 2, "x-windows-949", dict(KOREAN, event_id="event_id"), "NaN", note=True, mtime_rank=3),
    Variant("d", 3, "UTF-8", {"event_id": "Event ID", "temp": "Temp", "humid": " Humid ",
                              "press": "PRESS", "error": "Error"}, "null", mtime_rank=4),
    Variant("e", 4, "UTF-8", dict(KOREAN, event_id="event_id"), "N/A", mtime_rank=5),
    Variant("f", None, "UTF-8", dict(KOREAN, event_id="event_id"), "", mtime_rank=6),
    Variant("Error_log", 0, "UTF-8", dict(KOREAN, event_id="event_id"), "", mtime_rank=7),
]

BASE_MTIME_MS = 1_700_000_000_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _publish(spark: SparkSession, src_dir: str, dst_dir: str, stem: str, ext: str, mtime_ms: int) -> list[str]:
    """Give the part files of ``src_dir`` stable names in ``dst_dir`` and one mtime."""
    jvm, fs, src = _fs(spark, src_dir)
    parts = sorted(str(s.getPath().getName()) for s in fs.listStatus(src)
                   if str(s.getPath().getName()).startswith("part-"))
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(dst_dir))
    out = []
    for k, name in enumerate(parts):
        target = jvm.org.apache.hadoop.fs.Path(f"{dst_dir}/{stem}-{k:03d}{ext}")
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{src_dir}/{name}"), target)
        fs.setTimes(target, mtime_ms, -1)
        out.append(str(target))
    return out


def variant_frame(spark: SparkSession, sf_dir: str, v: Variant) -> DataFrame:
    s = td.sensor_raw(spark, sf_dir)
    s = s.where(F.lit(False)) if v.residue is None else s.where(F.col("event_id") % 5 == v.residue)
    cols = [F.col(c).alias(v.headers[c]) for c in ["event_id", "temp", "humid", "press", "error"]]
    if v.note:
        cols.append(F.lit(NOTE_TEXT).alias("비고"))
    return s.select(*cols)


def write_sensor_csvs(spark: SparkSession, sf_dir: str, root: str | None = None,
                      with_text_file: bool = True) -> str:
    """Write all variants (plus a non-CSV file) to ``<root>/data``; return that folder."""
    root = root or scratch_path(spark, "sensor-csv")
    data = f"{root}/data"
    for v in VARIANTS:
        tmp = f"{root}/staging/{v.name}"
        (variant_frame(spark, sf_dir, v).write.mode("overwrite")
         .option("header", True).option("encoding", v.charset).option("nullValue", v.null_token)
         .option("emptyValue", "").csv(tmp))
        _publish(spark, tmp, data, v.name, ".csv", BASE_MTIME_MS + v.mtime_rank * 60_000)
    if with_text_file:
        tmp = f"{root}/staging/notes"
        (td.sensor(spark, sf_dir).select(F.format_string("event %d", F.col("event_id")).alias("value"))
         .write.mode("overwrite").text(tmp))
        _publish(spark, tmp, data, "notes", ".txt", BASE_MTIME_MS)
    return data


def variant_of(file_name_col) -> F.Column:
    """Variant name of a published file name (the part before the last '-')."""
    return F.regexp_extract(file_name_col, r"^(.*)-\d+\.[a-z]+$", 1)
