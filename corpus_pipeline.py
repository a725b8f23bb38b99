"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import language, minhash, packing, pii, quality
from lattica.llm.common import free_name, id_bucket, remove, short_lived
from lattica.llm.queries import split_pattern, vocabulary
from lattica.sources.scratch import fresh

#: A text of SHORT characters or more whose best language is less near than this has none of the known ones: other languages and noise reach 0.09,
#: and of the clean texts of check_s none of that length has less than 0.13.  A shorter text has fewer trigrams to be near with, so it may be less near.
LEAST_NEAR, SHORT = 0.12, 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; learns from the languages given for three quarters of them.

    Null texts and texts without a letter go.  Repeated rows fare alike, very
    long texts are judged whole, an empty table stays empty, and extra columns
    pass through under any name.
    """
    profiles = language.learn(docs.where(id_bucket("doc_id", 4) != 2))
    into = free_name(docs, "found")
    least = LEAST_NEAR * F.sqrt(F.least(F.length("text") / SHORT, F.lit(1.0)))
    keep = (F.col(into)["lang_pred"] != language.UNKNOWN) & (F.col(into)["score"] >= least)
    return language.with_language(docs, profiles, into).where(keep).drop(into)


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the word rules and lie inside the compression bands.

    Null and empty texts go, for they have too few words.  Repeated rows fare
    alike, very long texts are judged whole and by chunk, an empty table stays
    empty, and extra columns pass through under any name.
    """
    into = free_name(docs, "found")
    return quality.with_quality(docs, into).where(F.col(into)["kept"]).drop(into)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class of near copies.

    Null and empty texts are one class; a null id comes last; of rows of equal
    id and text one stays (the first by its other columns as JSON).  An empty
    table stays empty, and extra columns pass through under any name.
    """
    return minhash.without_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text.

    No row goes.  Null texts stay null, repeated rows stay alike, an empty
    table stays empty, and extra columns pass through under any name.
    """
    out = docs.withColumn("text", pii.masked(F.col("text"), pii.learn(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null texts count as empty, repeated rows are packed each, an empty table gives none."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), split_pattern())


STAGES = [
    ("language", identify_language),
    ("quality", check_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language profiles nor the compressor nor the packing.  The tests hold run() against a plain version
#: that decides on each text by itself, finds near copies by comparing all pairs, and checks the packing piece by piece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage keeps is written and read again as the next one's input.

    Tables that a stage needed are removed when it is written, and its input
    when the next one has no more use for it.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh(spark, f"-{name}")
        with short_lived(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
