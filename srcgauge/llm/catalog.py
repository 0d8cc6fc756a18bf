"""The pipeline operators as named queries over the given tables.

Each query applies its operator to its whole table and derives the digest columns
of the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgauge.llm.balltree import exact_top_k
from srcgauge.llm.forest import nearest
from srcgauge.llm.html import main_text
from srcgauge.llm.language import language_id
from srcgauge.llm.lexical import rank_documents
from srcgauge.llm.licenses import license_scan
from srcgauge.llm.mixing import taken
from srcgauge.llm.neardup import near_duplicates
from srcgauge.llm.oracles import ORACLES  # noqa: F401  (the entry reads it here)
from srcgauge.llm.packing import pack_documents
from srcgauge.llm.pieces import encode_decode
from srcgauge.llm.sharding import shuffle_into_shards
from srcgauge.llm.spelling import spelling_variants
from srcgauge.llm.toxicity import toxicity
from srcgauge.sources.tables import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 8


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_host_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op4_log_ratio_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2)


def op7_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    digests = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shuffle_into_shards(digests, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), PIECE_BPE, digest=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op9_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = taken(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_document_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_projection_forest": op2_projection_forest,
    "op3_host_path_text": op3_host_path_text,
    "op4_log_ratio_toxicity": op4_log_ratio_toxicity,
    "op5_kneser_ney_language": op5_kneser_ney_language,
    "op6_super_minhash": op6_super_minhash,
    "op7_hypergeometric_sharding": op7_hypergeometric_sharding,
    "op8_prefix_table_pieces": op8_prefix_table_pieces,
    "op9_ball_tree": op9_ball_tree,
    "op10_sentence_rules": op10_sentence_rules,
    "op11_permuterm_variants": op11_permuterm_variants,
    "op12_source_mix": op12_source_mix,
    "op13_document_fp_tree": op13_document_fp_tree,
}
