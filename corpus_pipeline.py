"""From raw documents to token files: five operators, one after another.

Each stage gets what its predecessor kept, reread from Parquet, and its decisions take
effect: rejected, repeated, contaminated and undrawn documents are gone for the next one.
All stages but the last return the columns of ``documents``.

Defined cases: rows with null columns, empty texts and repeated rows go through every stage
as its operator defines them; repeated rows of one key and text leave the second stage once; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontam, minhash, mixing, tokens, toxicity
from loomtext.llm.store import materialize

KEY, TEXT = "doc_id", "text"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword softmax doesn't call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(TEXT).alias("text_"))
    return toxicity.score(row, model, text="text_", keep=["row_"]).where("predicted = 0").select("row_.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest key."""
    judged = minhash.near_duplicates(docs, KEY, TEXT, width=5, percent=80)
    kept = judged.where("kept").select(F.col(KEY).alias("kept_")).distinct()
    # The row is one struct beside the helper columns, so no input column clashes with them.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(KEY).alias("key_"), F.xxhash64(F.coalesce(F.col(TEXT).cast("string"), F.lit(""))).alias("hash_"))
    return rows.join(kept, F.col("key_").eqNullSafe(F.col("kept_")), "left_semi").dropDuplicates(["key_", "hash_"]).select("row_.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), KEY, TEXT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked weights of source, language and topic: ``mixing.SHARE`` of the tokens."""
    return mixing.sampled(docs, key=KEY, text=TEXT)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files of what is left, read back: one row per document."""
    import public_tokenizers

    got = tokens.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, key=KEY, text=TEXT)
    return got.select(F.col("key").alias(KEY), "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", without_toxic), ("minhash_near_dedup", one_of_each_group), ("benchmark_decontamination", without_benchmark), ("mixing", mixed), ("token_output", token_files)]

#: No stage but the mixing can be put as SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
