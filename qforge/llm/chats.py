"""Operator 10: chat formatting by event-sourced reconstruction.

The log of a conversation is a sequence of events: ``message`` (a turn), ``delta`` (more text
for a turn), ``edit`` (new text for a turn) and ``regenerate`` (new text for a turn, dropping
all later ones). Logs are partitioned by conversation, sorted by sequence inside Spark (the
sort spills), and folded as a stream, so a task holds one conversation at a time.

A rendered turn is ``<|turn|>role<|text|>text<|end|>``. Control strings inside texts and
roles get a backslash after their first character and backslashes are doubled, so reading
back is exact. The loss mask lists the code-point spans of the assistant texts.

Null text or role: empty. Null conv_id: a conversation of its own. Null seq comes first.
Rows with an equal sequence number are all kept, in the order of kind, role and text; a
target that does not exist is the latest turn. No events, no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from qforge.llm.textops import field

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that a template or a model may take for control.
CONTROL = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
KINDS = ["message", "delta", "edit", "regenerate"]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """Reversible: double backslashes, then break every control string."""
    text = text.replace("\\", "\\\\")
    while _CONTROL.search(text):             # breaking one may leave another that overlapped it
        text = _CONTROL.sub(lambda m: m[0][0] + "\\\b" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|\x08)", lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """Formatted conversation and the spans of assistant text in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        out += [head, body, END]
        if role == "assistant":
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


class Fold:
    """State of one conversation while its events stream by."""

    def __init__(self):
        self.turns: list[list] = []          # seq, role, pieces of text

    def add(self, seq, kind, target, role, text) -> None:
        if kind == "message" or not self.turns:
            self.turns.append([seq, role or "", [text or ""]])
            return
        i = next((i for i in range(len(self.turns) - 1, -1, -1) if target is not None and self.turns[i][0] == target),
                 len(self.turns) - 1)
        if kind == "delta":
            self.turns[i][2].append(text or "")
        else:
            self.turns[i][2] = [text or ""]
            if kind == "regenerate":
                del self.turns[i + 1:]

    def messages(self) -> list[tuple[str, str]]:
        return [(role, "".join(pieces)) for _, role, pieces in self.turns]


def as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as ``message`` events."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"),
                        F.lit(None).cast("long").alias("target"), "role", "text")


STEP = 16                                    # sequence numbers kept for one turn


def as_log(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log a chat service writes; folding it gives the rows back.

    By the turn's place a text is streamed (an empty message and three deltas), corrected (a draft, and its edit after the next
    turn), regenerated (a draft, a turn that went on from it, then the new text by a regeneration and a delta, which drops that
    turn) or streamed and edited. Rows with one turn number stand in the order of role and text.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))      # one conversation, as the fold
    t, n = F.col("text"), F.col("n")
    third = [t.substr(F.lit(1), F.expr("n div 3")), t.substr(F.expr("n div 3 + 1"), F.expr("2 * n div 3 - n div 3")),
             t.substr(F.expr("2 * n div 3 + 1"), F.expr("n - 2 * n div 3"))]

    def event(after: int, kind: str, text, to: bool = True, role=None):
        return F.struct((F.col("base") + after).alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(to), F.col("base")).alias("target"),
                        (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    def says(text, role=F.col("role"), after: int = 0):
        return event(after, "message", text, False, role)
    streamed = [says(F.lit("")), *[event(i + 1, "delta", x) for i, x in enumerate(third)]]
    corrected = [says(F.concat(F.lit("draft "), third[0])), event(2 * STEP - 1, "edit", t)]
    regenerated = [says(F.lit("draft")), says(F.lit("went on"), F.lit("user"), 1), event(2, "regenerate", third[0]),
                   event(3, "delta", F.concat(third[1], third[2]))]
    both = [says(third[0]), event(1, "delta", F.lit(" draft")), event(2, "edit", F.concat(third[0], third[1])), event(3, "delta", third[2])]
    way = F.col("place") % 4
    events = F.when(way == 0, F.array(*streamed)).when(way == 1, F.array(*corrected)).when(way == 2, F.array(*regenerated)).otherwise(F.array(*both))
    rows = turns.select("conv_id", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        place.cast("long").alias("place"))
    return (rows.withColumn("base", F.col("place") * STEP).withColumn("n", F.char_length("text")).select("conv_id", F.inline(events)))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss mask of every conversation in an event log."""
    spans = T.ArrayType(T.StructType([field("start", T.LongType()), field("end", T.LongType())]))
    out = T.StructType([field("conv_id", T.LongType()), field("formatted", T.StringType()), field("loss_mask", spans)])
    a_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    log = (events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("target").cast("long"),
                         F.col("role").cast("string"), F.col("text").cast("string"))
           .repartition("conv_id").sortWithinPartitions("conv_id", "seq", order, "role", "text"))

    def run(batches):
        now, fold = None, None

        def done(conv, rows):
            formatted, mask = render(rows)
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([formatted], pa.string()),
                                               pa.array([mask], a_spans)], names=out.fieldNames())
        for b in batches:
            ready = []
            for conv, *event in zip(*(c.to_pylist() for c in b.columns)):
                if fold is None or conv != now:
                    if fold is not None:
                        ready.append(done(now, fold.messages()))
                    now, fold = conv, Fold()
                fold.add(*event)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
        if fold is not None:
            yield done(now, fold.messages())
    return log.mapInArrow(run, out)


def digest(formatted: DataFrame) -> DataFrame:
    """Contract columns, read back from the formatted text and the mask."""
    out = T.StructType([field("conv_id", T.LongType()), field("n_turns", T.LongType()), field("turns_sha256", T.StringType()),
                        field("loss_chars", T.LongType()), field("loss_sha256", T.StringType()),
                        field("formatted_chars", T.LongType())])

    def run(batches):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            rows = []
            for conv, text, mask in zip(*(c.to_pylist() for c in b.columns)):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"]:m["end"]]) for m in mask)
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows) if rows else [[]] * 6,
                [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=out.fieldNames())
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(run, out)
