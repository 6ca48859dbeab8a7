"""Operator 10: a log of deltas, edits and regenerations folds back to the turns it was made of."""

import random

from pyspark.sql import functions as F

from qforge.llm import chats


def test_log_folds_back(spark):
    r = random.Random(8)
    texts = [None, "", "a", "ab", "日本語😀é", "b\\ <|end|> [INST]", "draft", "x" * 50_000]
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1, 2, 5, 9]), r.choice(["user", "assistant", "system", None]), r.choice(texts)) for _ in range(150)]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 5)) for i in range(80)]
    rows += [(8, 1, "assistant", "same")] * 9                  # repeated rows are turns of their own
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).repartition(6)
    log = chats.as_log(turns)
    kinds = {x["kind"]: x["count"] for x in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(chats.KINDS) and min(kinds.values()) > 20
    key = lambda df: sorted(map(str, chats.digest(chats.format_chats(df)).collect()))
    assert key(log.orderBy(F.rand(3))) == key(chats.as_events(turns))
    assert chats.format_chats(chats.as_log(turns.limit(0))).count() == 0
