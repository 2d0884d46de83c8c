"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossveil.llm import bpe, chat, divergence, languages, lines, negatives, ngrams, packing, passages, quality, tokenfile, vectors, warc
from mossveil.llm.common import materialise, scratch_dir, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def folder(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.bpe_decode(bpe.bpe_encode(docs, WORDS, digest="ids_sha256").drop("text"), WORDS)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), similarity=0.8)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ruled = materialise(quality.with_base_rules(docs).drop("text"))
    return quality.judge(ruled).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), WORDS, where, end_id=2)
    return tokenfile.read_tokens(spark, where, digest=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), BYTES, size=2048, end_id=1, with_ids=False)
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), min_words=50, similarity=0.8)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), where)
    captures = warc.assemble(warc.read_records(spark, where, payload=False))
    field = lambda name: F.element_at("metadata.fields", name).cast("long")
    return captures.select(
        field("pageId").alias("page_id"),
        F.coalesce("capture.payload_bytes", field("payloadBytes")).alias("payload_bytes"),
        F.col("capture.digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        field("refersToPage").alias("refers_to"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hint), (-7, 1, "assistant", hint)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.chat_windows(turns))


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", languages.held_out())
    model = languages.learn(docs.where("NOT held_out"))
    return languages.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least=30, top=50)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_vectors": op2_vectors,
    "op3_lines": op3_lines,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_passages": op7_passages,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_chat": op10_chat,
    "op11_languages": op11_languages,
    "op12_divergence": op12_divergence,
    "op13_negatives": op13_negatives,
}

ORACLES: dict[str, str] = {
    "op4_quality": quality.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_chat": chat.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
