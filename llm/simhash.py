"""Operator 7: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other have a common variant within half the radius of both. So every
distinct fingerprint emits all its variants within half the radius, variants are shuffled, and fingerprints that meet
at a variant are verified and linked. At most 65 fingerprints can meet at one variant, so no bucket is large however
many copies there are; exact copies are one fingerprint.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table
from llm.components import connected_components

RADIUS = 2
SHINGLE_WORDS = 3
_CHUNK = 1 << 16


def simhash(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if more than half of the XXH64 hashes (seed 42) of the text's word shingles have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else iter([words])
    total, counts, digest, join = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    while True:
        hashes = np.fromiter((digest(join(g), 42) for g in islice(grams, _CHUNK)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        if len(hashes) < _CHUNK:
            break
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(spark: SparkSession, text: str = "text") -> Column:
    """The fingerprint of a text column as a signed long."""
    ship_code(spark)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))

    return prints(F.col(text))


def variants(fp: Column, radius: int = RADIUS) -> Column:
    """All values within half the radius, rounded up, of a fingerprint."""
    masks = [sum(1 << b for b in bits) for n in range((radius + 1) // 2 + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fp.bitwiseXOR(m))


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within ``radius`` bits.

    Those that meet at a variant differ by at most twice half the radius; each is linked to the least one there if that
    verifies. For an even radius it always does, so nothing is lost; an odd one is refused.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    met = distinct.select("fp", F.explode(variants(F.col("fp"), radius)).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    return met.select(F.col("fp").alias("a"), least.alias("b")).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def _roots(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint; the root is the least fingerprint that links reach."""
    found = connected_components(linked_fingerprints(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included) for every row.

    Null and empty texts have fingerprint zero, linked like any other. Rows with a null id belong to components too; a
    component of null ids alone has a null component_id. Repeated rows each get a row. An empty table gives no rows.
    Other columns of ``docs`` are neither read nor returned. Texts are not shuffled.
    """
    prints = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(docs.sparkSession).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = cut(_roots(distinct, radius))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(components, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: the smallest doc_id, null after all others; of equal ids the first row.

    A row is told by its place in the checkpointed table, so repeated rows, rows of one id with several texts, and null
    ids are resolved like others. All columns of ``docs`` are kept; clashing names don't matter. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.struct("*").alias("doc"), fingerprint_column(spark).alias("fp"), F.monotonically_increasing_id().alias("row")))
    first = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").cast("long").alias("doc_id"), "row")
    distinct = cut(rows.groupBy("fp").agg(F.min(first).alias("first")))
    kept = _roots(distinct, radius).groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(cut(kept.select(F.col("first.row").alias("row"))), "row", "left_semi").select("doc.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
