"""CSV records that span lines, read from splittable files.

A quoted cell may hold line breaks, so the lines of a byte block mean different things inside and outside quotes, and
only the whole file before the block tells which. The scan finds out by composing the blocks' effects:

1. every block is read line by line under both assumptions (it starts inside quotes, or outside); its effect is the state
   after its last line under each. Outside, a quote opens a cell only at the cell's start; inside, a doubled quote is
   text and a single one closes. (With well-formed quotes the effect is the parity of the quotes: it flips or keeps.)
2. a file's effects are composed in the order of its blocks, which gives the state at the start of every block;
3. every block is read again and its lines are joined to records wherever the state is outside quotes. What is left over at
   the borders (the rest of a record begun before, the beginning of one that goes on) is joined by file and record;
4. ``from_csv`` parses the records.

So a file is parsed by as many tasks as it has blocks. Blocks are those of Spark's text source (split at line feeds, the
carriage return before one belongs to the line end), the same ones in every scan of the same files. Blank lines outside
quotes are skipped; a quote that is never closed makes the rest of its file one record. The first record is the header.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qforge.functions.columns import quote
from qforge.sources import encoding as enc

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not hold this package

#: Blocks with a state of their own (those that start inside quotes, and the last of each file) up to which these are sent
#: to every task, about 100 bytes each; beyond it lines are brought to them.
MAX_BLOCKS = 200_000

EFFECT = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()),
                       T.StructField("outside", T.BooleanType()), T.StructField("inside", T.BooleanType())])
START = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()),
                      T.StructField("start", T.BooleanType()), T.StructField("last", T.BooleanType())])
PIECE = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()),
                      T.StructField("kind", T.IntegerType()), T.StructField("text", T.BinaryType())])
WHOLE, END, MIDDLE, BEGIN = 0, 1, 2, 3      # a record, or its last, inner or first part


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, block, ord (scan order) and the bytes of every line, blank ones included."""
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("ord"), F.col("value").cast("binary").alias("v")))


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open after the line."""
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == b'"':                  # a quote opens a cell at its start only
                at += 1
            else:
                at = line.find(b",", at) + 1
                if at == 0:
                    return False
                continue
        inside = False
        while True:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] != b'"':
                break
            at += 2
        at = line.find(b",", at) + 1                      # closed: on to the next cell
        if at == 0:
            return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Stretches of one file's block within a batch."""
    n = batch.num_rows
    if not n:
        return
    block = batch.column(1).to_numpy()
    path = batch.column(0).dictionary_encode()
    which = path.indices.to_numpy()
    cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(which) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n]):
        yield (path.dictionary[int(which[a])].as_py(), int(block[a])), batch.slice(a, b - a)


def _quoted(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lines, pattern='"').to_numpy(zero_copy_only=False))


def block_effects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The state after every block, if it starts outside and if it starts inside quotes."""
    def run(batches):
        key, state = None, (False, True)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([state[0]]), pa.array([state[1]])],
                                              names=EFFECT.fieldNames())
        for batch in batches:
            for new, part in _runs(batch):
                if new != key:
                    if key is not None:
                        yield row()
                    key, state = new, (False, True)
                lines = part.column(2)
                for i in _quoted(lines).tolist():
                    line = lines[i].as_py()
                    state = (inside_after(line, state[0]), inside_after(line, state[1]))
        if key is not None:
            yield row()
    return raw_lines(spark, paths).select("path", "block", "v").mapInArrow(run, EFFECT)


def block_starts(effects: DataFrame) -> DataFrame:
    """The state at the start of every block and whether it is the file's last; one file's blocks (a row each) a group."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        start, now = [], False
        for outside, inside in zip(pdf["outside"].tolist(), pdf["inside"].tolist()):
            start.append(now)
            now = inside if now else outside
        return pd.DataFrame({"path": pdf["path"], "block": pdf["block"], "start": start, "last": pdf.index == len(pdf) - 1})
    return effects.groupBy("path").applyInPandas(compose, START)


def _cut(borders: bool):
    """Lines of blocks in order -> whole records, or (``borders``) the parts of records that cross a border."""
    def run(batches):
        key, state, last, header, crossing, pending = None, False, False, False, False, []

        def flush():
            """What is left when a block ends."""
            if not pending:
                return []
            text = b"\n".join(pending)
            if last and not crossing:                     # never closed
                return [] if borders else [(WHOLE, text)]
            kind = (END if last else MIDDLE) if crossing else BEGIN
            return [(kind, text)] if borders else []

        def rows(got):
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.string()), pa.array([key[1]] * len(got), pa.int64()),
                                               pa.array([k for k, _ in got], pa.int32()), pa.array([t for _, t in got], pa.binary())],
                                              names=PIECE.fieldNames())
        for batch in batches:
            for new, part in _runs(batch):
                if new != key:
                    if key is not None:
                        yield rows(flush())
                    key, pending = new, []
                    state = crossing = bool(part.column(3)[0].as_py())
                    last, header = bool(part.column(4)[0].as_py()), new[1] == 0
                lines, got, begin = part.column(2).to_pylist(), [], 0
                after = np.empty(len(lines), bool)
                at = 0
                for i in _quoted(part.column(2)).tolist():
                    after[at:i] = state
                    state = after[i] = inside_after(lines[i], state)
                    at = i + 1
                after[at:] = state
                for end in np.flatnonzero(~after).tolist():
                    text = b"\n".join([*pending, *lines[begin:end + 1]]) if pending or end > begin else lines[end]
                    begin, pending, was, crossing = end + 1, [], crossing, False
                    if was:
                        if borders:
                            got.append((END, text))
                    elif text.strip():
                        if header:
                            header = False
                        elif not borders:
                            got.append((WHOLE, text))
                pending = [*pending, *lines[begin:]]
                if got:
                    yield rows(got)
        if key is not None:
            yield rows(flush())
    return run


def records(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """path and decoded text of every data record of files in one charset."""
    starts = block_starts(block_effects(spark, paths)).where("start OR last").checkpoint()
    lines = raw_lines(spark, paths)
    known = starts.count()
    if known <= MAX_BLOCKS:
        lines = lines.join(F.broadcast(starts), ["path", "block"], "left")      # rows stay in the order of the scan
    else:
        lines = lines.join(starts, ["path", "block"], "left").repartition("path", "block").sortWithinPartitions("path", "block", "ord")
    lines = lines.select("path", "block", "v", F.coalesce("start", F.lit(False)).alias("start"), F.coalesce("last", F.lit(False)).alias("last"))
    text = F.col("text").cast("string") if charset == "utf-8" else F.decode("text", enc.JVM_CHARSET[charset])
    out = lines.mapInArrow(_cut(False), PIECE).select("path", text.alias("text"))
    if not starts.where("start").isEmpty():
        in_file = Window.partitionBy("path").orderBy("block", F.col("kind") == BEGIN)       # at most two parts a block
        parts = (lines.mapInArrow(_cut(True), PIECE).select("path", "block", "kind", text.alias("text"))
                 .withColumn("first", F.last(F.when(F.col("kind") == BEGIN, F.col("block")), ignorenulls=True).over(in_file)))
        whole = parts.groupBy("path", "first").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        out = out.unionByName(whole.select("path", F.concat_ws("\n", F.transform("parts", lambda p: p["text"])).alias("text")))
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


def parsed(rows: DataFrame, columns: list[str], corrupt: str, options: dict[str, str]) -> DataFrame:
    """``columns`` and ``corrupt`` (strings) of every record, and ``path``."""
    ddl = ", ".join(f"{quote(c)} STRING" for c in [*columns, corrupt])
    made = F.from_csv(F.col("text"), ddl, {**options, "columnNameOfCorruptRecord": corrupt})
    return rows.select(F.col("path").alias("__path"), made.alias("__row")).select(
        *[F.col("__row").getField(c).alias(c) for c in [*columns, corrupt]], F.col("__path"))
