"""From documents to token ids: quality rules, near duplicates, repeated passages,
benchmark passages, byte-level BPE. Each stage takes what the one before it kept.

A stage deletes the tables it worked with, but for those that its rows are read
from, which stay in the shared folder as its rows may be read at any time; run()
deletes these too, once the rows are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import discard, materialize, release, scratch, table
from voxelloom.llm.graph import without_ids
from voxelloom.llm.op1_mcd import judged
from voxelloom.llm.op3_parity import jaccard_components
from voxelloom.llm.op5_decontam import build_index, contamination
from voxelloom.llm.op6_substring import without_repeats
from voxelloom.llm.op7_bpe import bpe_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text has no words and goes; repeated
    rows are judged alike; an empty table stays empty; other columns are kept as they are."""
    return judged(docs, tuple(docs.columns)).where("verdict.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id
    (shingles of five words, similarity 0.8). Rows that repeat id and text are
    one; rows that share an id with different texts stay or go together. Rows
    without an id or without words stay."""
    with scratch() as own:
        groups = jaccard_components(docs, k=5, num=80, den=100)
        copies = own.keep(materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))
        repeated = own.keep(materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated"))
    kept = without_ids(docs, copies)
    if not repeated.limit(1).count():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return without_ids(kept, repeated).union(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document of a smaller
    id has; those of which nothing is left, and null and empty texts, go."""
    return without_repeats(docs).where(F.length("text") > 0)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item. Rows that share an
    id go together; rows without an id stay; a null text has no words and stays."""
    with scratch() as own:
        index = materialize(build_index(docs), "index", compression="zstd")
        hit = contamination(index, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0).select("id").distinct()
        hit = own.keep(materialize(hit, "contaminated"))
    return without_ids(docs, hit)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the bytes they decode to;
    a null text is empty."""
    import public_tokenizers as P

    return bpe_tokens(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("tokens", tokens)]

#: Components and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, part in STAGES[:-1]:
        with scratch() as own:
            docs = own.keep(materialize(part(spark, docs, sf_dir), name, compression="zstd"))
        if before is not None:
            discard(before)
        before = docs
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
