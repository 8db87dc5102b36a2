"""The thin registered queries of this subpackage; each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, kneser, media, merkle, minhash, mixing, ngramjoin, suffix, tokens, toxicity, trie, urls, warc
from .ordinal import numbered
from .store import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the bundles back."""
    got = warc.archive_and_read(_table(spark, sf_dir, "pages"), with_payload=False)
    return got.select(warc.key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.key_of(F.col("refers_to")).alias("refers_to"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document, on four-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte covered by a 400-byte string that starts anywhere else is removed."""
    got = suffix.remove_repeats(_table(spark, sf_dir, "documents"), 400)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every document, read back."""
    import public_tokenizers

    got = tokens.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return got.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability and draw of every document."""
    got = mixing.mix(_table(spark, sf_dir, "documents"))
    return got.select(F.col("k").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents that are labelled good."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser.perplexities(_table(spark, sf_dir, "documents"), good)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows of fold 0 are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (toxicity.fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures of all vectors (no table holds pictures, so each vector is drawn as one)."""
    pictures = media.rendered(_table(spark, sf_dir, "embeddings"))
    return media.copies(pictures, "vec_id", "image")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by every document."""
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it verifies after one in seven was tampered with."""
    docs = _table(spark, sf_dir, "documents")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    claim = F.when(hit, merkle.leaf_of("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    got = merkle.manifest(docs, extra={"claim": claim})
    got = got.select(F.col("key").alias("doc_id"), *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest("proof").alias("proof_sha256"), merkle.folded(F.coalesce("claim", "leaf"), "proof").alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their hundred's first one, and all their ids: (c, depth, role, text), (conv_id)."""
    kept = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("c"), "turn", *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")])
    placed = materialize(numbered(kept, "c", ["turn", "role", "text"], "turns-placed"), "turns-numbered")
    convs = placed.select("c", "n").distinct().select("c", (F.crc32(F.col("c").cast("string")) % 6).alias("h"), (F.col("c") - F.col("c") % 100).alias("base"))
    # A base gives five turns at most, to a hundred conversations at most.
    heads = materialize(placed.where("c % 100 = 0 AND i < 5").select(F.col("c").alias("base"), "n", "i", "role", "text"), "heads")
    convs = materialize(convs.join(heads.select("base", "n").distinct(), "base", "left").select("c", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "convs")
    lent = convs.join(heads, "base").where("i < h").select("c", F.col("i").alias("depth"), "role", "text")
    own = placed.join(convs, "c").where("i >= h").select("c", (F.col("taken") + F.col("i") - F.col("h")).alias("depth"), "role", "text")
    return lent.union(own).withColumnRenamed("c", "conv_id"), convs.select(F.col("c").alias("conv_id"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns, convs = rebuilt(_table(spark, sf_dir, "conversations"))
    return trie.trie(turns, convs, order=("depth",))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are alike, by vertical partitioning."""
    return ngramjoin.jaccard_join(_table(spark, sf_dir, "documents"), width=5, percent=80)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
