"""The operators as registered queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from qforge.llm import (bpe, chats, lattice, licenses, merkle, packing, phrases, secret_scan, site_quality, token_groups, toxicity,
                        vector_codes, winnow)
from qforge.llm.oracles import ORACLE  # noqa: F401 - read by the entry

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_hashing(spark, sf_dir):
    """Links and component of every vector."""
    return lattice.link(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark, sf_dir, path: str | None = None):
    """Token count and digests of ids and decoded bytes of every document."""
    ranks = bpe.load_ranks(spark, path or public_tokenizers.path(RANKS))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_phrase_automata(spark, sf_dir):
    """Words of every document without passages that an earlier document has."""
    return phrases.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_best_fit_sharding(spark, sf_dir):
    """All documents in 8 shards of near equal bytes, equal texts together."""
    return packing.digest(packing.pack_into(packing.sized(table(spark, sf_dir, "documents")), 8))


def op5_token_group_matrix(spark, sf_dir):
    """Shingle count and near-duplicate component of every document."""
    return token_groups.join(table(spark, sf_dir, "documents"))


def op6_winnowing(spark, sf_dir):
    """Benchmark hits of every document."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return winnow.digest(winnow.find_spans(docs, bench, ["doc_id"]))


def op7_randomness_battery(spark, sf_dir):
    """Secret spans of every document."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"]))


def op8_hierarchical_bayes(spark, sf_dir):
    """Posterior of quality and toxicity of every document, and the decision."""
    docs = table(spark, sf_dir, "documents")
    host, path = site_quality.host_and_path(docs)
    return site_quality.judge(docs, table(spark, sf_dir, "labels"), host, path, ["doc_id"])


def op9_rare_token_index(spark, sf_dir):
    """Licence phrases and labels of every document."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"]))


def op10_event_chats(spark, sf_dir):
    """All conversations, and one whose texts imitate control strings, from a log with deltas, edits and regenerations, formatted and read back."""
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chats.digest(chats.format_chats(chats.as_log(rows)))


def op11_adaptive_bounds(spark, sf_dir):
    """Code, error and label error of every vector, and the digest of all codebooks."""
    return vector_codes.digest(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_weighted_lexicon(spark, sf_dir):
    """Toxicity score and decision of every document."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sibling_shift(spark, sf_dir):
    """Leaf, roots, proof digest and verification of every document."""
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lattice_hashing, op2_byte_bpe, op3_phrase_automata, op4_best_fit_sharding, op5_token_group_matrix, op6_winnowing, op7_randomness_battery, op8_hierarchical_bayes,
    op9_rare_token_index, op10_event_chats, op11_adaptive_bounds, op12_weighted_lexicon, op13_sibling_shift)}
