"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import embed_index, grammar, media, mixing, ngram, quality, recompress, shard, substring, wordbpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    return shard.shard_rows(spark, rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return grammar.read_ids(grammar.write_ids(spark, docs, _vocabulary("word_bpe_49k.json")).df)


def op3_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wordbpe.encode_texts(spark, _table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return embed_index.nearest(spark, vectors, vectors.where("vec_id % 20 = 0"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.near_duplicates(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(spark, docs, labels)
    return quality.score(spark, docs, machine).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


#: Shares of the mixture's tokens by domain.
WEIGHTS = {"clean": 0.94, "toxic": 0.02, "low": 0.03, "low_toxic": 0.01}


def op8_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(spark, docs, _table(spark, sf_dir, "labels"), weights=WEIGHTS)
    posterior = [F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *posterior, "rate", "copies")


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op10_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(spark, _table(spark, sf_dir, "documents")).df)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_repair_ids": op2_repair_ids,
        "op3_distinct_word_bpe": op3_distinct_word_bpe,
        "op4_multi_index_hashing": op4_multi_index_hashing,
        "op5_hypergeometric_shards": op5_hypergeometric_shards,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_factorisation_machine": op7_factorisation_machine,
        "op8_soft_membership_mixing": op8_soft_membership_mixing,
        "op9_recompression_dedup": op9_recompression_dedup,
        "op10_chunked_media": op10_chunked_media,
    }


def oracle_sql() -> dict[str, str]:
    return {}
