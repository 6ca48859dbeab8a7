"""Per-file charset detection for CSV sources (part of S1/S2).

A wrong charset does not fail in Spark - it silently yields U+FFFD - so
the "try encodings until one parses" pattern cannot be used; detection
is explicit and distributed:

pass 1 (JVM only): every line of every file is read through the text
  source, which keeps the bytes; per file we aggregate "all lines are
  valid UTF-8", the line count, the header line (the first line of the
  block at offset 0, by scan order), whether a line has an odd number of
  quotes (a record may then span lines) and the most cells of a line.
pass 2 (only for files that are not UTF-8): a vectorised pandas UDF
  checks CP949 validity of the same lines.
CP949 trail bytes never equal newline, comma or quote, so line splitting
on bytes is safe and both passes stay splittable.
"""

from __future__ import annotations

import csv
import io
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python codec name -> JVM charset for Spark's CSV reader.
# Python's cp949 equals the JVM's x-windows-949 (the JVM's "cp949" is a
# different table); it needs spark.sql.legacy.javaCharsets=true.
JVM_CHARSET = {
    "utf-8": "UTF-8",
    "cp949": "x-windows-949",
    "latin-1": "ISO-8859-1",
}

# Detection order for the batch-analysis reader and for the upload reader.
ANALYSIS_CHAIN = ("utf-8", "cp949")
UPLOAD_CHAIN = ("utf-8", "cp949", "latin-1")

def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per line that is not blank: path, block_start, ord (scan order), v (the bytes, unchecked)."""
    return (spark.read.text(paths)
            .select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block_start"),
                    F.monotonically_increasing_id().alias("ord"), F.col("value").alias("v"))
            .where(F.trim("v") != ""))


def occurrences(text: Column, char: str) -> Column:
    """How often an ASCII character stands in a text, counted on the bytes."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def cells(line: Column) -> Column:
    """Cells of a CSV record: commas outside quotes, and one."""
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    return occurrences(bare, ",") + 1


def _cp949_udf():
    """Vectorised CP949 validity check, built per call.

    Defined as a closure so it is shipped to the executors by value: the
    Python workers need pandas, not this package. Python's cp949 codec
    decides (the JVM's table accepts a few more codes). The whole Arrow
    batch is decoded as one blob first (newline never occurs inside a CP949
    multibyte sequence); only a failing batch is checked line by line.
    """
    def line_ok(s) -> bool:
        if s is None:
            return True
        try:
            s.decode("cp949")
            return True
        except UnicodeError:
            return False

    def check(v: pd.Series) -> pd.Series:
        blob = b"\n".join(bytes(x) for x in v if x is not None)
        try:
            blob.decode("cp949")
            return pd.Series(True, index=v.index)
        except UnicodeError:
            return v.map(line_ok).astype(bool)

    return F.pandas_udf(check, T.BooleanType())


def norm_path(p: str) -> str:
    """Comparable form of a file path: URI escapes decoded, file: scheme folded."""
    p = unquote(p)
    if p.startswith("file:"):
        p = "/" + p[len("file:"):].lstrip("/")
    return p


def detect(spark: SparkSession, paths: list[str], chain: tuple[str, ...] = ANALYSIS_CHAIN) -> DataFrame:
    """path (as given), charset (None when no codec of the chain fits), n_lines, header (decoded text),
    odd_quotes (a line has an odd number of quotes), max_cells (of a line).

    Only per-file summaries (bounded by the number of files) reach the driver.
    Scan metadata reports URI-encoded paths; they are mapped back to the
    caller's strings, which are also what the second pass reads.
    """
    schema = "path string, charset string, n_lines long, header string, odd_quotes boolean, max_cells long"
    if not paths:
        return spark.createDataFrame([], schema)
    lines = raw_lines(spark, paths)
    per_file = (lines.groupBy("path")
                .agg(F.bool_and(F.is_valid_utf8("v")).alias("utf8"), F.count(F.lit(1)).alias("n_lines"),
                     F.bool_or(occurrences(F.col("v"), '"') % 2 == 1).alias("odd_quotes"),
                     F.max(cells(F.col("v"))).alias("max_cells"),
                     F.min_by(F.col("v").cast("binary"), F.when(F.col("block_start") == 0, F.col("ord"))).alias("first"))
                .collect())  # bounded: one row per file
    given = {norm_path(p): p for p in paths}
    found = {given.get(norm_path(r["path"]), r["path"]): r for r in per_file}
    charsets: dict[str, str | None] = {}
    need_cp949 = []
    for p, r in found.items():
        if r["utf8"] and "utf-8" in chain:
            charsets[p] = "utf-8"
        else:
            need_cp949.append(p)
    if need_cp949 and "cp949" in chain:
        # ASCII lines are valid CP949: only lines with other bytes go through Python
        non_ascii = raw_lines(spark, need_cp949).where(F.col("v").rlike("[^\\x00-\\x7F]"))   # scans only those files
        rows = (non_ascii.groupBy("path")
                .agg(F.bool_and(_cp949_udf()(F.col("v").cast("binary"))).alias("ok")).collect())  # bounded: per file
        verdict = {norm_path(r["path"]): r["ok"] for r in rows}
        for p in need_cp949:
            # a non-UTF-8 file always has a non-ASCII line, so it always has a verdict
            if verdict.get(norm_path(p), False):
                charsets[p] = "cp949"
    for p in need_cp949:
        if p not in charsets:
            charsets[p] = "latin-1" if "latin-1" in chain else None
    out = []
    for p, r in found.items():
        cs = charsets[p]
        header = decode_header(r["first"], cs) if cs else None
        out.append((p, cs, int(r["n_lines"]), header, r["odd_quotes"], int(r["max_cells"])))
    return spark.createDataFrame(out, schema)


def decode_header(first_line: bytes | None, charset: str) -> str | None:
    if first_line is None:
        return None
    codec = "utf-8-sig" if charset == "utf-8" else charset
    return bytes(first_line).decode(codec)


def parse_header(header: str) -> list[str]:
    """Column names of a CSV header line (quoted names allowed)."""
    return next(csv.reader(io.StringIO(header)))
