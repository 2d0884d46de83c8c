"""A corpus pipeline: quality rules, line dedup, one document of near-duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mossveil.llm import lines, ngrams, packing, passages, quality

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from a host that does; null and empty texts fail them.

    Repeated rows are judged alike; null sources are one host; no documents give none; further columns stay.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds, also with one word changed.

    Documents of which no word is left by that go. Null and empty texts and null ids stay; rows that repeat an id and a
    text lose the same lines; no documents give none; further columns stay.
    """
    return lines.keep_first_lines(docs, similarity=0.8)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Rows that share an id stay or go together; null ids and texts without words stay; no documents give none; further
    columns stay.
    """
    return ngrams.keep_one(docs, threshold=0.8, n=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents of which no word is left by that go.

    Rows that share an id but not the text are documents of their own. Null and empty texts and null ids stay; no
    documents give none; further columns stay.
    """
    return passages.cut_passages(docs, min_words=50, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of ids, one piece of one document each.

    Null and empty texts are the end id alone; repeated rows are packed each for itself; no documents give no pieces.
    """
    # Workers outlive the stage: beside the heap of the other stages, a small and short memory of stretches has to do.
    pieces = packing.cut_pieces(docs, TOKENIZER, size=2048, end_id=1, with_ids=False, remembered=100_000, forget=True)
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL cannot express the joins by edits, signatures and chains; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
