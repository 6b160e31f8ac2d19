"""Integer vectors of an embedding table, packed in blocks for array work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 2048
#: Integers beyond this aren't taken: squares of their differences would not fit a long. It is far above what embeddings hold.
LARGEST = 1 << 26


def scaled(vectors: DataFrame, scale: int, *others: Column) -> DataFrame:
    """(x, length, and other columns) of the rows whose vector is not null and holds only finite components: each component c is floor(scale * c)."""
    v = F.col("_v")
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("_v"), *others)
    rows = rows.where(v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False)))
    large = F.exists("x", lambda c: F.abs(c) > LARGEST)
    x = F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST / scale:g}"))).otherwise(F.col("x"))
    return rows.withColumn("x", F.transform(v, lambda c: F.floor(c * float(scale)))).withColumn("x", x).withColumn("length", F.size("x")).drop("_v")


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of vectors that there are: those of the models that made them, each handled by itself."""
    return sorted(r["length"] for r in rows.select("length").distinct().collect())


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    """A column of integer vectors of one length as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def gathered(blocks: DataFrame, least: int = 16) -> DataFrame:
    """The blocks in fewer tasks, without a shuffle, where there would be fewer than ``least`` in a task; every core keeps one."""
    spark = blocks.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks.count() // least))
    return blocks.coalesce(tasks)
