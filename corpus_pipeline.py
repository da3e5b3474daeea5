"""The corpus pipeline: from raw documents to token ids, one written table per stage.

Quality rules, line dedup, near-duplicate removal by n-gram Jaccard, mixing of sources, byte-level BPE. Every stage
takes (spark, docs, sf_dir), works on all rows of the stage before, and returns the columns of ``documents``; the last
returns the tokens of each document of the mixture.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, jaccard, lines, mixing, quality
from shelfmark.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs.select(*COLUMNS))


def _cut(docs: DataFrame, spare: float | None) -> DataFrame:
    """Documents without the lines that earlier ones have; one of which nothing is left goes."""
    done = lines.dedup_lines(docs.select(*COLUMNS), spare=spare)
    left = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(lines.NOT_BLANK))
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, short ones too, that earlier ones have; a document of which nothing is left goes.

    A document that would lose half of its text or more is passed on whole: the next stage tells whether it is a near copy,
    and a stub would no longer show. That stage cuts it if it stays.
    """
    return _cut(docs, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word n-grams have a similarity of 0.8 or more, without lines that earlier
    documents have: what line dedup has passed on whole, and is no near copy, is cut here."""
    return _cut(stored(jaccard.keep_first(docs.select(*COLUMNS), n=5, percent=80), "firsts"), None)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, a row for each reading."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded bytes."""
    both = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(bpe.VOCABULARY))
    return both.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", tokens),
]

#: SQL cannot express byte-pair merges; a test compares the rows of run() with all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
