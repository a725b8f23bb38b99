"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts ``docs``, ordered by id, into ``shards`` contiguous runs of near-equal bytes.

    Rows are range-partitioned by id (ties by their place in the input, so that
    even one id on a third of all rows is spread), each partition's bytes and
    rows are totalled, and the running totals of these few rows give every
    partition its global offset.  A row belongs to the shard in which the
    middle of its bytes falls when the whole is cut at equal targets, so a
    shard is at most one text away from its target.

    Returns id, ``size`` (UTF-8 bytes plus 1; a null text has none),
    ``text_crc32`` (0 for null and empty), ``shard``, ``slot`` (place in the
    shard, gapless from 0) and ``position`` (place in the whole).  Null ids
    come first.  Repeated rows each get a place of their own.  An empty table
    gives an empty result.  Other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Range bounds are sampled anew on each run, so the partition of a row is written down once.
    ranged = checkpointed(rows.repartitionByRange("id", "tie").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition, so one task and a broadcast hold them at any size of the input.
    offsets = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("bytes_all"),
        )
    )
    inside = Window.partitionBy("part").orderBy("id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.select("*", F.sum("size").over(inside).alias("upto"), F.count(F.lit(1)).over(inside).alias("nth"))
        .join(F.broadcast(offsets), "part")
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("position", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.lit(shards - 1).cast("long"), F.expr(f"(middle2 * {shards}L) div (2L * bytes_all)")).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("shard_first"))  # at most one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("position") - F.col("shard_first")).alias("slot"), "position"
    )
