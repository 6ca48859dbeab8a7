"""What a task's Python holds at once: batches of bounded bytes, few bytes a pre-token."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qforge.llm import bpe
from qforge.llm.queries import RANKS

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontaminate", "tokens"])
def test_stages_take_batches_of_bounded_bytes(unbounded, name):
    """2,000 texts of 20,000 bytes in one partition are 40 MB; fewer than Spark's 10,000 rows a batch."""
    spark, sf = unbounded, "/root/testdata/sf0.001"
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{sf}/documents.parquet").limit(20), sf)
    docs = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 2000).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])
    found = docs.mapInArrow(size, "size long, n long").collect()
    assert sum(r["n"] for r in found) == 2000 and max(r["size"] for r in found) < 5 << 20


def test_encoder_holds_few_bytes_a_pre_token():
    ranks = bpe.load_ranks(None, public_tokenizers.path(RANKS))
    enc = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = " ".join(str(i % 10) * 3 for i in range(500))
    texts, want = [text] * 800, enc.encode([text])[0]

    def bytes_a_token(run):
        tracemalloc.start()
        try:
            run()
            return tracemalloc.get_traced_memory()[1] / (len(want) * len(texts))
        finally:
            tracemalloc.stop()
    # a number of 4 bytes a pre-token and the work on one text; numbers and ids of 8 bytes each before
    assert bytes_a_token(lambda: all(np.array_equal(x, want) for x in enc.each(texts))) < 8
    assert [x.tolist() for x in enc.encode(texts[:2] + [""])] == [want.tolist()] * 2 + [[]]
