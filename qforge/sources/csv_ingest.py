"""Sensor CSV ingest.

Flow for a set of files:
1. charset + header per file (``encoding.detect``; bounded per-file rows);
2. header names are de-duplicated, normalised and mapped to canonical
   names (metadata work on the driver);
3. files sharing (charset, header) are read by ONE CSV scan with an
   all-string schema (the header line of every file is skipped);
4. the groups are united by name (missing columns -> NULL);
5. the NA tokens become NULL, then one aggregate infers each column's
   type (long, double, boolean or string) and the columns are cast.
Nothing but per-file and per-column summaries reaches the driver.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qforge.functions.columns import as_double, col, is_missing, quote
from qforge.functions.names import CANONICAL_SENSOR_NAMES, normalize_names
from qforge.functions.order_stats import exact_quantiles
from qforge.session import path_exists, remove_path, scratch_path
from qforge.sources import csv_records as REC
from qforge.sources import encoding as enc
from qforge.sources.encoding import norm_path
from qforge.sources.manifest import base_name

# The default missing-value tokens of the pandas CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Spellings the pandas reader takes as booleans.
BOOL_TRUE = ["True", "TRUE", "true"]
BOOL_FALSE = ["False", "FALSE", "false"]

# Shapes of integer and floating-point text. Testing the shape first keeps
# inference free of failing casts (a failing try_cast costs an exception
# per value); only 19-digit text is cast to see whether it fits 64 bits.
INT_TEXT = r"^\s*[+-]?[0-9]{1,18}\s*$"
INT19_TEXT = r"^\s*[+-]?[0-9]{19}\s*$"
FLOAT_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"

SOURCE_COL = "_source_file"
CORRUPT_COL = "__corrupt_record"
RAGGED = "a record has more cells than the header"
#: Bytes up to which a file's content is hashed as a whole.
WHOLE_FILE = 64 << 20
PROFILE = ("array<struct<position: int, column: string, dtype: string, n_rows: long, null_count: long, count: long, mean: double, "
           "std: double, min: double, p25: double, p50: double, p75: double, max: double>>")
LEDGER = f"file_name string, digest string, rows long, cols long, is_sensor_file boolean, profile {PROFILE}, _batch string"


@dataclass
class FileInfo:
    path: str
    file_name: str
    charset: str | None
    n_lines: int
    raw_names: list[str]
    columns: list[str]
    error: str | None = None
    records: int | None = None      # parsed data records, when they differ from lines
    multiline: bool = False         # a quoted cell may hold line breaks

    @property
    def rows(self) -> int:
        return self.records if self.records is not None else max(self.n_lines - 1, 0)


def unnamed(names: list[str]) -> list[str]:
    """An empty header name (e.g. from a trailing comma) becomes "Unnamed: <position>", as in pandas."""
    return [n if n.strip() else f"Unnamed: {i}" for i, n in enumerate(names)]


def dedupe_names(names: list[str]) -> list[str]:
    """Repeated header names get .1, .2 ... suffixes (first one unchanged)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}.{seen[n]}"
            out.append(cand)
            seen[cand] = 0
        else:
            seen[n] = 0
            out.append(n)
    return out


def inspect_files(spark: SparkSession, paths: list[str], chain=enc.ANALYSIS_CHAIN,
                  rename: dict[str, str] | None = None) -> list[FileInfo]:
    """Charset, record count and normalised columns for each file (bounded by #files).

    A file with an odd number of quotes in some line may have quoted line
    breaks: its lines are joined to records (``csv_records``) and those are counted
    by a parse. A record with more cells than the header is the file's error.
    """
    det = {r["path"]: r for r in enc.detect(spark, paths, chain).collect()}  # bounded: per file
    by_norm = {norm_path(k): r for k, r in det.items()}
    infos = []
    for p in paths:
        r = det.get(p) or by_norm.get(norm_path(p))
        name = p.rstrip("/").split("/")[-1]
        if r is None:  # empty file: no line at all
            infos.append(FileInfo(p, name, None, 0, [], []))
            continue
        raw = dedupe_names(unnamed(enc.parse_header(r["header"]))) if r["header"] is not None else []
        try:
            cols = normalize_names(raw, CANONICAL_SENSOR_NAMES if rename is None else rename) if raw else []
            err = None
        except ValueError as e:          # e.g. two headers that normalise to one name
            cols, err = [], str(e)
        # keep the caller's path string: callers select files by it
        if cols and not r["odd_quotes"] and r["max_cells"] > len(cols):
            err = RAGGED
        infos.append(FileInfo(p, name, r["charset"], int(r["n_lines"]), raw, cols, err, multiline=bool(r["odd_quotes"])))
    count_records(spark, [i for i in infos if i.multiline])
    return infos


def csv_options(charset: str, multiline: bool = False) -> dict[str, str]:
    """The one CSV dialect of batch and stream: doubled quotes inside quoted cells, a backslash is plain text."""
    return {"header": "true", "encoding": enc.JVM_CHARSET[charset], "mode": "PERMISSIVE", "quote": '"', "escape": '"',
            "multiLine": str(multiline).lower()}


def read_group(spark: SparkSession, paths: list[str], charset: str, columns: list[str],
               multiline: bool = False, strict: bool = True) -> DataFrame:
    """One CSV scan for files that share charset and header; all columns as strings.

    ``multiline`` allows quoted fields with line breaks (files are split into
    tasks all the same, see ``csv_records``). A record with more cells than
    the header raises with its file's name; with ``strict=False`` its raw text
    stays in ``CORRUPT_COL`` instead. Missing cells at the end are NULL.
    """
    if multiline:
        rows = REC.parsed(REC.records(spark, paths, charset), columns, CORRUPT_COL, csv_options(charset, True)).withColumnRenamed("__path", SOURCE_COL)
    else:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*columns, CORRUPT_COL]])
        rows = (spark.read.schema(schema)
                .options(enforceSchema="true", columnNameOfCorruptRecord=CORRUPT_COL, **csv_options(charset))
                .csv(paths)
                .withColumn(SOURCE_COL, F.col("_metadata.file_path")))
    rows = keep_ragged(rows, columns)
    if not strict:
        return rows
    said = F.concat(col(SOURCE_COL), F.lit(": "), ragged_text(col(columns[0])))
    return rows.where(F.when(col(CORRUPT_COL).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop(CORRUPT_COL)


def keep_ragged(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``CORRUPT_COL`` only of records with more cells than the header."""
    return rows.withColumn(CORRUPT_COL, F.when(enc.cells(col(CORRUPT_COL)) > len(columns), col(CORRUPT_COL)))


def ragged_text(first: Column) -> Column:
    """What is said of a ragged record; it names a data column too, as Spark refuses scans of the raw text alone."""
    return F.concat(F.lit(f"{RAGGED}; first cell: "), F.coalesce(first, F.lit("")))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column missing from a frame is NULL there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def na_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(col(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(col(c))
                           for c in cols})


def infer_types(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """One aggregate: each string column becomes bigint, double, boolean or string."""
    aggs = []
    for i, c in enumerate(cols):
        x = col(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(INT_TEXT) | F.when(x.rlike(INT19_TEXT), F.expr(f"try_cast({quote(c)} AS BIGINT)").isNotNull())
                            .otherwise(False)).alias(f"l{i}"),
                 F.count_if(x.rlike(FLOAT_TEXT)).alias(f"d{i}"),
                 F.count_if(x.isin(BOOL_TRUE + BOOL_FALSE)).alias(f"b{i}")]
    if not aggs:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    out = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "double"           # an all-missing column is numeric NaN in pandas
        elif row[f"l{i}"] == n:
            # integers with gaps become floating point, as in pandas
            out[c] = "bigint" if n == row["rows"] else "double"
        elif row[f"d{i}"] == n:          # the float shape includes every integer shape
            out[c] = "double"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    exprs = {}
    for c, t in types.items():
        if t == "boolean":
            exprs[c] = F.when(col(c).isin(BOOL_TRUE), True).when(col(c).isin(BOOL_FALSE), False)
        elif t == "double":
            exprs[c] = as_double(F.expr(f"try_cast({quote(c)} AS DOUBLE)"))
        elif t != "string":
            exprs[c] = F.expr(f"try_cast({quote(c)} AS {t})")
    return df.withColumns(exprs) if exprs else df


def read_csv_strings(spark: SparkSession, paths: list[str], chain=enc.ANALYSIS_CHAIN,
                     rename: dict[str, str] | None = None, infos: list[FileInfo] | None = None,
                     multiline: bool = False) -> tuple[DataFrame, list[str]]:
    """Parsed but untyped rows of many CSV files: (strings with NA tokens as NULL, column order)."""
    infos = infos if infos is not None else inspect_files(spark, paths, chain, rename)
    bad = [f"{i.file_name} ({i.error})" if i.error else i.file_name
           for i in infos if i.charset is None or i.error or not i.columns]
    if bad:
        raise ValueError(f"cannot decode or parse: {', '.join(sorted(bad))}")
    groups: dict[tuple, list[str]] = {}
    for i in infos:
        groups.setdefault((i.charset, tuple(i.columns), multiline or i.multiline), []).append(i.path)
    order: list[str] = []
    for i in infos:
        for c in i.columns:
            if c not in order:
                order.append(c)
    frames = [read_group(spark, ps, cs, list(cols), many) for (cs, cols, many), ps in groups.items()]
    return na_to_null(union_by_name(frames), order), order


def count_records(spark: SparkSession, infos: list[FileInfo], multiline: bool = True) -> list[FileInfo]:
    """Per-file data records from a parse (needed when records span lines); one grouped scan.

    A record with more cells than the header becomes the file's error.
    """
    ok = [i for i in infos if i.charset and i.columns]
    groups: dict[tuple, list[str]] = {}
    for i in ok:
        groups.setdefault((i.charset, tuple(i.columns)), []).append(i.path)
    counts: dict[str, int] = {}
    for (cs, cols), ps in groups.items():
        parsed = read_group(spark, ps, cs, list(cols), multiline, strict=False)
        rows = (parsed.select(SOURCE_COL, CORRUPT_COL, col(cols[0]).alias("first_cell")).groupBy(SOURCE_COL)
                .agg(F.count(F.lit(1)).alias("n"), F.count(CORRUPT_COL).alias("ragged"), F.count("first_cell").alias("filled"))
                .collect())  # bounded: one row per file
        counts.update({norm_path(r[SOURCE_COL]): (int(r["n"]), int(r["ragged"])) for r in rows})
    for i in ok:
        i.records, ragged = counts.get(norm_path(i.path), (0, 0))
        i.error = RAGGED if ragged else i.error
    return infos


def read_csv_files(spark: SparkSession, paths: list[str], chain=enc.ANALYSIS_CHAIN,
                   rename: dict[str, str] | None = None, keep_source: bool = False,
                   infos: list[FileInfo] | None = None, multiline: bool = False) -> DataFrame:
    """S1 + S6 + S7 + S8 + U1: many CSV files in mixed charsets -> one typed table."""
    merged, order = read_csv_strings(spark, paths, chain, rename, infos, multiline)
    typed = apply_types(merged, infer_types(merged, order))
    return typed.select(*[col(c) for c in order], *([SOURCE_COL] if keep_source else []))


def land_csv_files(spark: SparkSession, paths: list[str], path: str, chain=enc.ANALYSIS_CHAIN,
                   rename: dict[str, str] | None = None, infos: list[FileInfo] | None = None,
                   row_id: str | None = None, multiline: bool = False) -> DataFrame:
    """K1: CSV files -> typed Parquet table at ``path``, parsing the text only once.

    The parsed strings are written to the scratch folder first; type
    inference and the typed write then read that columnar copy instead of
    re-parsing the CSV text, and it is removed. ``row_id`` adds a persistent row id.
    """
    merged, order = read_csv_strings(spark, paths, chain, rename, infos, multiline)
    if row_id:
        merged = merged.withColumn(row_id, F.monotonically_increasing_id())
    strings = scratch_path(spark, "csv-strings")
    merged.write.parquet(strings)
    staged = spark.read.parquet(strings)
    typed = apply_types(staged, infer_types(staged, order))
    typed.select(*[col(c) for c in order], *([row_id] if row_id else [])).write.mode("overwrite").parquet(path)
    remove_path(spark, strings)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- S9 / S3
def file_summary(spark: SparkSession, infos: list[FileInfo]) -> DataFrame:
    """file_name, rows, cols for every file (header-only and empty files give 0)."""
    return spark.createDataFrame([(i.file_name, i.rows, len(i.columns)) for i in infos],
                                 "file_name string, rows long, cols long")


def ingest_report(spark: SparkSession, paths: list[str], chain=enc.UPLOAD_CHAIN,
                  rename: dict[str, str] | None = None, infos: list[FileInfo] | None = None) -> DataFrame:
    """S3: one row per offered file: file_name, status, error, rows, cols.

    Names not ending in .csv are rejected; a file that is empty, cannot be
    decoded, has clashing column names or a record with more cells than the
    header fails on its own without stopping the rest.
    """
    csvs = [p for p in paths if p.endswith(".csv")]
    rows = [(p.rstrip("/").split("/")[-1], "failed", "only CSV files are accepted", None, None)
            for p in paths if not p.endswith(".csv")]
    if infos is None:
        infos = inspect_files(spark, csvs, chain, rename) if csvs else []
    for i in infos:
        if i.charset is None and i.n_lines:
            rows.append((i.file_name, "failed", "no supported character encoding fits", None, None))
        elif i.error or not i.columns:
            rows.append((i.file_name, "failed", i.error or "no columns to parse", None, None))
        else:
            rows.append((i.file_name, "success", None, i.rows, len(i.columns)))
    return spark.createDataFrame(rows, "file_name string, status string, error string, rows long, cols long")


def content_digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Digest of every file's content: SHA-256 up to ``WHOLE_FILE`` bytes.

    A larger file is not held by one task: its digest is taken from its size, number of lines and the sums of two hashes of
    its lines, so it does not depend on the order of lines (nor does the table that is read from it).
    """
    files = spark.read.format("binaryFile").load(paths)
    sizes = {r["path"]: r["length"] for r in files.select("path", "length").collect()}                 # bounded: per file
    small, large = ([p for p, n in sizes.items() if (n <= WHOLE_FILE) == few] for few in (True, False))
    out = {}
    if small:
        got = spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("d")).collect()
        out.update({norm_path(r["path"]): r["d"] for r in got})
    if large:
        v = F.col("v").cast("binary")
        sums = (enc.raw_lines(spark, large).groupBy("path")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(v).cast("decimal(38,0)")).alias("a"),
                     F.sum(F.crc32(F.concat(v, F.lit(b"\x01")))).alias("b")).collect())
        out.update({norm_path(r["path"]): hashlib.sha256(f"lines:{r['n']}:{r['a']}:{r['b']}".encode()).hexdigest() for r in sums})
    return {p: out[norm_path(p)] for p in paths if norm_path(p) in out}


def file_profiles(rows: DataFrame, cols: list[str]) -> DataFrame:
    """path and ``profile``: per column of a file n_rows, dtype, null_count, count, mean, std, min, quartiles and max.

    One grouping by (file, column). The quartiles of a file's column are exact and taken by one task, which holds its distinct values.
    """
    kinds = {c: rows.schema[c].dataType for c in cols}
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kinds[c].simpleString()).alias("dtype"), is_missing(rows, c).alias("gone"),
                      (as_double(c) if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")).alias("x")) for i, c in enumerate(cols)]
    long = rows.select(F.col(SOURCE_COL).alias("path"), F.inline(F.array(*cells)))
    one = long.groupBy("path", "position", "column", "dtype").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("gone").alias("null_count"), F.count_if(~F.col("gone")).alias("count"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.percentile("x", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("q"), F.max("x").alias("max"))
    fields = ["position", "column", "dtype", "n_rows", "null_count", "count", "mean", "std", "min", *[F.try_element_at("q", F.lit(i)).alias(f"p{25 * i}") for i in (1, 2, 3)], "max"]
    return one.select("path", F.struct(*fields).alias("c")).groupBy("path").agg(F.array_sort(F.collect_list("c")).alias("profile"))


def read_ledger(spark: SparkSession, landing: str) -> DataFrame:
    """The record of every landed file: file_name, digest, rows, cols, is_sensor_file, profile, batch."""
    return spark.read.schema(LEDGER).parquet(f"{landing}/_ledger")


def wider(a: str, b: str) -> str:
    """The type that holds values of both: integers and floating point are double, other mixtures text."""
    return a if a == b else "double" if {a, b} == {"bigint", "double"} else "string"


def read_landed(spark: SparkSession, landing: str) -> DataFrame:
    """Rows of the batches whose record is complete; a column that batches hold in different types has the wider one."""
    own = F.transform("profile", lambda c: F.struct(c["column"], c["dtype"])).alias("types")
    layouts: dict[tuple, list[str]] = {}
    for r in read_ledger(spark, landing).where("profile IS NOT NULL").select("_batch", own).distinct().collect():      # a row or a few a batch
        layouts.setdefault(tuple((t["column"], t["dtype"]) for t in r["types"]), []).append(r["_batch"])
    if not layouts:
        raise ValueError(f"no complete batch with rows in {landing}")
    types: dict[str, str] = {}
    for layout in layouts:
        for c, t in layout:
            types[c] = wider(types.get(c, t), t)
    frames = []
    for layout, batches in layouts.items():                # a scan for all batches of one layout
        rows = spark.read.option("basePath", landing).parquet(*[f"{landing}/_batch={b}" for b in sorted(set(batches))])
        frames.append(rows.select(*[col(c).cast(types[c]).alias(c) for c, _ in layout], SOURCE_COL, "_ingested_at",
                                  F.col("_batch").cast("string").alias("_batch")))
    return union_by_name(frames).select(*[col(c) for c in types], SOURCE_COL, "_ingested_at", "_batch")


def land_uploads(spark: SparkSession, paths: list[str], landing: str, chain=enc.UPLOAD_CHAIN,
                 rename: dict[str, str] | None = None, batch: str | None = None) -> DataFrame:
    """Ingest a batch of offered files and add the good ones to a Parquet table.

    Each landed row keeps its source file and the ingest time. The table is partitioned by ``_batch`` (by
    default a digest of the paths) and a batch that is landed again replaces itself, so a retry doubles no
    rows. A file whose content another batch has landed, or an earlier file of this one holds, is a ``duplicate`` and lands
    nothing. The ledger (``_ledger``) gets one record a landed file after its rows: digest, shape, sensor flag and profile.
    Returns the per-file report with digest, sensor flag and profile; raises when no file of the batch could be ingested.
    """
    csvs = [p for p in paths if p.endswith(".csv")]
    all_infos = inspect_files(spark, csvs, chain, rename) if csvs else []   # one detection pass
    report = require_success(ingest_report(spark, paths, chain, rename, infos=all_infos))
    good = [i for i in all_infos if i.charset and i.columns and not i.error]
    name = batch or hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]
    digests = content_digests(spark, [i.path for i in good])
    known = set()
    if path_exists(spark, f"{landing}/_ledger"):
        offered = spark.createDataFrame([(d,) for d in set(digests.values())], "digest string")            # a row an offered file
        known = {r["digest"] for r in read_ledger(spark, landing).where(F.col("_batch") != name)
                 .join(F.broadcast(offered), "digest", "left_semi").select("digest").distinct().collect()}
    infos, twice = [], set()
    for i in sorted(good, key=lambda i: i.path):
        d = digests[i.path]
        (twice.add(i.path) if d in known else infos.append(i))
        known.add(d)
    profiles = spark.createDataFrame([], f"path string, profile {PROFILE}")
    if infos:
        rows = read_csv_files(spark, [i.path for i in infos], chain, rename, keep_source=True, infos=infos)
        cols = [c for c in rows.columns if c != SOURCE_COL]
        stored = f"{landing}/_batch={name}"
        (rows.withColumn("_ingested_at", F.current_timestamp()).withColumn("_batch", F.lit(name))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(landing))
        profiles = file_profiles(spark.read.parquet(stored), cols)
    facts = spark.createDataFrame(
        [(i.file_name, norm_path(i.path), digests[i.path], not re.search("error", i.file_name, re.IGNORECASE), i.path in twice) for i in good],
        "f string, own string, digest string, is_sensor_file boolean, twice boolean")
    by_name = profiles.collect()                              # bounded: a row a file, a cell a column
    named = spark.createDataFrame([(norm_path(r["path"]), r["profile"]) for r in by_name], f"own2 string, profile {PROFILE}")
    facts = facts.join(F.broadcast(named), F.col("own") == F.col("own2"), "left")
    full = report.join(F.broadcast(facts), F.col("file_name") == F.col("f"), "left").select(
        "file_name", F.when(F.col("twice"), "duplicate").otherwise(F.col("status")).alias("status"), "error", "rows", "cols", "digest", "is_sensor_file", "profile")
    full = full.checkpoint()
    (full.where("status = 'success'").select("file_name", "digest", "rows", "cols", "is_sensor_file", "profile").withColumn("_batch", F.lit(name))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{landing}/_ledger"))
    return full


def require_success(report: DataFrame) -> DataFrame:
    """The batch fails as a whole only when no file succeeded."""
    if report.where(F.col("status") == "success").limit(1).count() == 0:
        raise ValueError("no file of the batch could be ingested")
    return report


# ---------------------------------------------------------------- S10
def text_summary(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, str | None, int | None]]:
    """unique / top / freq of text columns: distinct count and most frequent value (of equally frequent ones the largest).

    One grouping for all columns by (column, SHA-256 of the value), combined map-side, so an exchange carries 32 bytes a value however
    long the texts are. A second scan takes the largest of the values whose digest has the highest count; where no value
    repeats that is the column's maximum. One row a column reaches the driver.
    """
    if not cols:
        return {}
    cells = [F.struct(F.lit(i).alias("ci"), col(c).alias("v")) for i, c in enumerate(cols)]
    values = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL").withColumn("d", F.unhex(F.sha2("v", 256)))
    counts = values.groupBy("ci", "d").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    found = {r["ci"]: r for r in counts.groupBy("ci").agg(F.count(F.lit(1)).alias("u"), F.max("n").alias("freq")).collect()}   # a row a column
    most = F.element_at(F.create_map(*[x for i, r in found.items() for x in (F.lit(i), F.lit(r["freq"]))]), F.col("ci")) if found else F.lit(0)
    once = [i for i, r in found.items() if r["freq"] == 1]
    top = F.max("v").alias("top")
    tops = values.where(F.col("ci").isin(once)).groupBy("ci").agg(top)
    if len(once) < len(found):
        first = counts.where(~F.col("ci").isin(once)).where(F.col("n") == most).select("ci", "d")
        tops = tops.unionByName(values.join(first, ["ci", "d"], "left_semi").groupBy("ci").agg(top))
    best = {r["ci"]: r["top"] for r in tops.collect()}                                                                         # a row a column
    return {c: (found[i]["u"], best[i], found[i]["freq"]) if i in found else (0, None, None) for i, c in enumerate(cols)}


def dataset_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: dtype, null_count, count, mean, std, min, p25, p50, p75, max
    (numeric columns), unique, top, freq (text columns), plus n_rows and n_cols."""
    cols = cols or df.columns
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = text_summary(df, [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)])
    qs = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(is_missing(df, c)).alias(f"z{i}"))
        if c in numeric:
            x = as_double(c)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    wide = df.agg(*aggs)
    null = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(cols):
        num = c in numeric
        q = qs.get(c, [None, None, None])
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col(f"z{i}").alias("null_count"),
            (F.col(f"n{i}") if num else F.col("n_rows") - F.col(f"z{i}")).alias("count"),
            (F.round(F.col(f"m{i}"), 6) if num else null).alias("mean"),
            (F.round(F.col(f"s{i}"), 6) if num else null).alias("std"),
            (F.col(f"a{i}") if num else null).alias("min"),
            F.round(F.lit(q[0]).cast("double"), 6).alias("p25"),
            F.round(F.lit(q[1]).cast("double"), 6).alias("p50"),
            F.round(F.lit(q[2]).cast("double"), 6).alias("p75"),
            (F.col(f"b{i}") if num else null).alias("max"),
            F.lit(texts[c][0] if c in texts else None).cast("long").alias("unique"),
            F.lit(texts[c][1] if c in texts else None).cast("string").alias("top"),
            F.lit(texts[c][2] if c in texts else None).cast("long").alias("freq")))
    return wide.select("n_rows", F.lit(len(cols)).alias("n_cols"), F.inline(F.array(*rows)))


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows of a table (a fixed-size preview is the feature here).

    With ``order_by`` the rows are the first in that order (a distributed
    top-n); without it, any n rows.
    """
    if order_by:
        return df.orderBy(*[col(c) for c in order_by]).limit(n)
    return df.limit(n)


# ---------------------------------------------------------------- K1 / K2
def land(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a table (overwrite) and return its path; Parquet by default."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    return path


__all__ = ["NA_TOKENS", "FileInfo", "inspect_files", "read_group", "union_by_name", "na_to_null",
           "read_csv_strings", "land_csv_files", "count_records",
           "infer_types", "apply_types", "read_csv_files", "file_summary", "ingest_report", "land_uploads",
           "text_summary",
           "require_success", "dataset_profile", "preview", "land", "base_name"]
