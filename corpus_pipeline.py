"""From raw documents to token ids in five stages, each one of the corpus operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again as the next one's docs. All but the last return the columns of their docs, so
columns beyond those of the documents table pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import mixing, ngram, quality, substring, wordbpe
from tempora.llm.scratch import fresh, settled, stash
from tempora.plans.ship import ship

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.3
#: Near-duplicates on word shingles: five words, similarity 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
REPEAT_BYTES = 200
#: Expected tokens of each domain after mixing, as multiples of what the stage is given.
FACTORS = {"clean": 1.0, "toxic": 0.0, "low": 0.0, "low_toxic": 0.0}
#: No document comes twice, and one that is most likely clean stays.
MOST_RATE, PULL = 1.0, 0.1


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject; empty texts are judged too."""
    ship(spark)
    labels = _labels(spark, sf_dir).select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(spark, docs, labels)
    score = fresh(docs.columns, "score")
    return quality.score(spark, docs, machine, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one with the least doc_id, the first in the table among equals.

    Rows without words are in no group and stay.
    """
    ship(spark)
    docs = settled(spark, docs)
    groups = ngram.near_duplicates(spark, docs, SHINGLE_WORDS, SIMILARITY_PERCENT, count_links=False)
    wordless = groups.where("n_shingles = 0").select("rid")
    first = (
        groups.where("n_shingles > 0")
        .groupBy("group_id")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "rid")).alias("m"))
        .select(F.col("m.rid").alias("rid"))
    )
    kept = stash(spark, first.union(wordless), "kept").df
    names = docs.columns
    rid = fresh(names, "rid")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    return rows.join(kept.withColumnRenamed("rid", rid), rid, "left_semi").select(*names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the byte strings that start anywhere else too; n_chars follows the text. Rows left empty stay."""
    ship(spark)
    return substring.without_repeats(spark, docs, REPEAT_BYTES)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once or not at all, as its rounded rate says: nearly all clean rows, toxic and low ones hardly ever."""
    ship(spark)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    mixed = mixing.mix(spark, rows, _labels(spark, sf_dir), factors=FACTORS, pull=PULL, most=MOST_RATE, rounds=1)
    return mixed.where("copies > 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids."""
    ship(spark)
    import public_tokenizers

    return wordbpe.encode_texts(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_domains),
    ("byte-level BPE encoding and decoding", encode),
]
#: A learned classifier, joins on n-gram sets and token merges are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        fresh = stash(spark, out, f"stage{k + 1}")
        if table is not None:
            table.drop()
        table, docs = fresh, fresh.df
    return docs
