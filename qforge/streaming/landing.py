"""Incremental landing of arriving sensor CSV files (S2/S3 as a stream).

Uploaded files are dropped into a folder; a Structured Streaming file
source picks up each new file exactly once (the checkpoint under
``spark.checkpoint.dir`` records what was read), applies the same
NA-token and canonical-name rules as the batch reader, and appends to a
Parquet landing table together with per-batch missing-value counters.
``foreachBatch`` makes both writes idempotent per batch id, so a restart
after a lost executor or driver replays a batch without duplicating it.

A stream needs one schema up front: it is taken from the header and
charset of the files already present (or given explicitly). A file with a
record of more cells than the header, or with a value that does not fit its
column's type, is left out as a whole and named in ``table_dir/rejected``;
nothing is cut or turned into NULL. Quoted line breaks are read, so each file
is read by one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from qforge.functions.columns import col, quote
from qforge.session import checkpoint_dir
from qforge.sources import csv_ingest as CI
from qforge.sources import encoding as enc
from qforge.sources import manifest as MF

PROBLEM_COL, TEXT_COL = "__problem", "__text"


def infer_stream_layout(spark: SparkSession, source_dir: str) -> tuple[str, list[str], list[str]]:
    """(charset, raw header names, canonical names) of the files already in the folder."""
    paths = [r["path"] for r in MF.sensor_files(MF.file_manifest(spark, source_dir)).select("path").collect()]
    infos = [i for i in CI.inspect_files(spark, paths, enc.UPLOAD_CHAIN) if i.columns]
    if not infos:
        raise ValueError("no readable sensor file to take the stream layout from")
    layouts = {(i.charset, tuple(i.columns)) for i in infos}
    if len(layouts) > 1:
        raise ValueError("files in the folder disagree on charset or header; give the layout explicitly")
    i = infos[0]
    return i.charset, i.raw_names, i.columns


def sensor_stream(spark: SparkSession, source_dir: str, columns: list[str], charset: str = "utf-8",
                  types: dict[str, str] | None = None, max_files_per_trigger: int | None = None,
                  strict: bool = True) -> DataFrame:
    """Streaming DataFrame of new sensor rows with canonical names and types.

    A faulty record (more cells than the header, a value that does not fit its type) raises with its file's name;
    with ``strict=False`` the fault stays in ``PROBLEM_COL`` instead.
    """
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*columns, CI.CORRUPT_COL]])
    reader = (spark.readStream.schema(schema)
              .options(enforceSchema="true", columnNameOfCorruptRecord=CI.CORRUPT_COL, **CI.csv_options(charset, multiline=True))
              .option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(source_dir).withColumn(CI.SOURCE_COL, F.col("_metadata.file_path"))
    # the batch reader's file-name rule: error logs are not sensor data
    raw = raw.where(~MF.base_name(F.col(CI.SOURCE_COL)).rlike(MF.ERROR_FILE_PATTERN))
    types = types or default_types(columns)
    text = CI.na_to_null(CI.keep_ragged(raw, columns), columns).withColumn(TEXT_COL, F.struct(*[col(c) for c in columns]))
    typed = CI.apply_types(text.withColumns({c: whole_number(c) for c, t in types.items() if t == "bigint"}), types)
    faults = [F.when(col(CI.CORRUPT_COL).isNotNull(), CI.ragged_text(F.col(TEXT_COL).getField(columns[0])))]
    faults += [F.when(col(c).isNull() & F.col(TEXT_COL).getField(c).isNotNull(), F.concat(
        F.lit(f"a value of {c} is not {t}: "), F.col(TEXT_COL).getField(c))) for c, t in types.items() if t != "string"]
    typed = typed.withColumn(PROBLEM_COL, F.coalesce(*faults)).drop(CI.CORRUPT_COL, TEXT_COL)
    if strict:
        said = F.concat(col(CI.SOURCE_COL), F.lit(": "), col(PROBLEM_COL))
        typed = typed.where(F.when(col(PROBLEM_COL).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop(PROBLEM_COL)
    return typed.withColumn("_ingested_at", F.current_timestamp())


def whole_number(c: str) -> Column:
    """Text of an integer column: floating-point text of a whole number ('1.0') as that integer, other text as it is.

    The batch reader makes such a column double; a stream's type is fixed, and the integer is the same number.
    """
    x = F.expr(f"try_cast({quote(c)} AS DOUBLE)")
    whole = col(c).rlike(CI.FLOAT_TEXT) & ~col(c).rlike(CI.INT_TEXT) & ~col(c).rlike(CI.INT19_TEXT) & (x == F.rint(x)) & (F.abs(x) < 2 ** 53)
    return F.when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(col(c))


def default_types(columns: list[str]) -> dict[str, str]:
    """Canonical sensor columns are numeric; anything else stays text."""
    known = {"temp": "double", "humid": "double", "press": "double", "error": "bigint", "event_id": "bigint"}
    return {c: known.get(c, "string") for c in columns}


def start_landing(spark: SparkSession, source_dir: str, table_dir: str, columns: list[str] | None = None,
                  charset: str | None = None, checkpoint: str | None = None,
                  available_now: bool = False, processing_time: str = "30 seconds",
                  stream_name: str = "default") -> StreamingQuery:
    """Append arriving rows to ``table_dir/rows`` and per-batch counters to ``table_dir/batches``.

    Files with a faulty record go to ``table_dir/rejected`` (file, error, rows) instead, as a whole.

    Several streams (one per file layout) may land in the same table; each
    writes its own ``_stream`` partition. Read the rows back with
    ``mergeSchema`` when layouts differ in their columns.
    """
    if columns is None or charset is None:
        charset, _, columns = infer_stream_layout(spark, source_dir)
    stream = sensor_stream(spark, source_dir, columns, charset, strict=False)
    # a stable name: a restarted stream must find the same checkpoint
    digest = hashlib.sha1(table_dir.encode("utf-8")).hexdigest()[:16]
    ckpt = checkpoint or f"{checkpoint_dir(spark)}/qforge-streams/landing-{stream_name}-{digest}"

    def land(batch: DataFrame, batch_id: int) -> None:
        files = batch.groupBy(CI.SOURCE_COL).agg(
            F.count(F.lit(1)).alias("rows"), F.min(PROBLEM_COL).alias("error"),
            *[F.count_if(col(c).isNull()).alias(f"missing_{c}") for c in columns]).collect()   # bounded: one row per file
        bad = [r[CI.SOURCE_COL] for r in files if r["error"] is not None]
        good = batch.where(~F.col(CI.SOURCE_COL).isin(bad)) if bad else batch
        _replace(good.drop(PROBLEM_COL), batch_id, f"{table_dir}/rows")
        counters = T.StructType([T.StructField(CI.SOURCE_COL, T.StringType()),
                                 *[T.StructField(c, T.LongType()) for c in ["rows", *[f"missing_{c}" for c in columns]]]])
        _replace(batch.sparkSession.createDataFrame([[r[f] for f in counters.names] for r in files if r["error"] is None], counters),
                 batch_id, f"{table_dir}/batches")
        if bad:
            _replace(batch.sparkSession.createDataFrame([(r[CI.SOURCE_COL], r["error"], r["rows"]) for r in files if r["error"] is not None],
                                                        f"{CI.SOURCE_COL} string, error string, rows long"), batch_id, f"{table_dir}/rejected")

    def _replace(df: DataFrame, batch_id: int, path: str) -> None:
        """Replace this batch's slice on replay instead of appending twice."""
        (df.withColumn("_stream", F.lit(stream_name)).withColumn("_batch_id", F.lit(batch_id))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_stream", "_batch_id").parquet(path))

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
