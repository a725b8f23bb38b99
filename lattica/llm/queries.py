"""The benchmark queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, language, licenses, minhash, packing, pii, quality, sharding, suffix_tree
from .common import id_bucket

SHARDS = 8
NEIGHBOURS = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary; its package is named here alone, so that the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(documents(spark, sf_dir), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def spans_text(spans: str, only_base: bool):  # noqa: ANN201
    some = F.filter(spans, lambda s: s["base"]) if only_base else F.col(spans)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.with_spans(docs, pii.learn(docs), "found").select("doc_id", "found")
    of = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(spans_text("found", True), 256).alias("base_sha256"),
        spans_text("found", False).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    rows = bpe.encode_documents(documents(spark, sf_dir), path, and_decode=True)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = id_bucket("doc_id", 4) == 2
    rows = language.with_language(docs, language.learn(docs.where(~held_out)), "found")
    return rows.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, NEIGHBOURS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.with_quality(documents(spark, sf_dir).select("doc_id", "text"), "found")
    return rows.select("doc_id", *[F.col(f"found.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks", "n_chunks")])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), split_pattern())


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.jaccard_join(documents(spark, sf_dir))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = id_bucket("doc_id", 7) == 2
    model = suffix_tree.learn(docs.where(~held_out), whole=True)
    return suffix_tree.score(docs.withColumn("held_out", held_out), model, extra=("held_out",))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_pii, op3_bpe, op4_licenses, op5_language, op6_ann, op7_quality, op8_packing, op9_ngram_join, op10_suffix_tree)
}
