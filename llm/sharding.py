"""Operator 3: shards that all match the mixture of the sources.

Proportional stratified interleaving: rows are shuffled by a seeded hash within each source and ranked; the fraction
of its source that precedes a row orders all rows; equal cuts of that order are the shards. Each shard then has every
source in its share of the whole, and row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import positions, table

#: Up to so many sources their counts are broadcast; they are counted first.
BROADCAST_SOURCES = 10_000


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, source, size, text_crc32, law (``rows``), shard from 0, slot in the shard from 0, grown_shard (null).

    Size: UTF-8 bytes of the text (null: none) plus 16. Both sorts move narrow rows without texts and split a hot
    source over range partitions. A null source is a source of its own; rows with equal id and text are
    interchangeable, so either order gives the same result. With fewer rows than shards some shards are empty; an
    empty table gives no rows. Of a very long text only its size and hashes leave the scan. Other columns of ``docs`` are
    neither read nor returned.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(raw).cast("long") + 16).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_shuffled"),
    )
    ranked = positions(rows, "source", "_shuffled", "doc_id", "text_crc32")
    # The first place and the number of rows of each source; the sources are few, or joined by a shuffle.
    counts = ranked.groupBy(F.col("source").alias("_source")).agg(F.min("position").alias("_first"), F.count("*").alias("_n"))
    few = counts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    at = ranked.join(F.broadcast(counts) if few else counts, F.col("source").eqNullSafe(F.col("_source")))
    fraction = (F.col("position") - F.col("_first") + 0.5) / F.col("_n").cast("double")
    placed = positions(
        at.select("doc_id", "source", "size", "text_crc32", "_shuffled", fraction.alias("_fraction")), "_fraction", "source", "_shuffled", "doc_id", "text_crc32"
    )
    total = placed.count()
    # shard s holds the positions from ceil(s * total / shards) to before ceil((s + 1) * total / shards)
    shard = F.expr(f"position * {shards}L div {max(total, 1)}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("position") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).drop("source")
