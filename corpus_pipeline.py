"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, BPE encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a
stage returns as Parquet to the shared folder and rereads it as the next one's docs. All stages but the last return the
columns of documents; the last returns doc_id, n_tokens and the digests of ids and decoded bytes, one row for each time
that the mix takes a document.

What a stage returns reads tables of its own in the shared folder; they are deleted when the next stage begins, unless
that reads them itself (if what it gets wasn't written first).

Defined results, in each stage: a null text counts as empty, so it fails quality_rules' base and goes there; a null doc_id
is an id like any other; rows that repeat another count each in quality_rules, and one stays after exact_dedup; an empty
table gives an empty table; all columns of documents stay as they are, whatever other columns are called.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sylva.llm.common import drop_folder, materialise, scratch, table
from sylva.llm.op01_bpe import TOKENIZER, digests, encode_decode
from sylva.llm.op03_quality import keep_good
from sylva.llm.op04_ngram_join import keep_representatives
from sylva.llm.op09_mix import training_documents
from sylva.llm.op10_exact_dedup import drop_duplicates

#: Near duplicates: shingles of so many words, and so many percent of similarity.
WORDS, PERCENT = 5, 80
_left: list[str] = []


def stage(function):
    """Deletes the tables that the stage before has left, and notes those that this one leaves."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = docs.inputFiles() if _left else []
        for folder in [x for x in _left if not any(x.rsplit("/", 1)[1] in f for f in reads)]:
            drop_folder(spark, folder)
            _left.remove(folder)
        with scratch() as made:
            out = function(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


@stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_duplicates(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram join (WORDS, PERCENT) the smallest doc_id stays."""
    return keep_representatives(docs, WORDS, PERCENT)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position."""
    return training_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens."""
    return digests(encode_decode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

ORACLE_SQL = None  # robust estimates and merges can't be said in SQL; tests hold the stages' operators against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = materialise(function(spark, docs, sf_dir), name)
    return docs
