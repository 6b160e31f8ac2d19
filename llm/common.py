"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D; Java's \s means just these.
WORD, SPACE = r"\S++", r"\s++"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the session or the cluster has set in ``spark.checkpoint.dir``.

    Where none is set a session on one machine gets a temporary one; on a cluster, whose machines don't share theirs,
    that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return context.getCheckpointDir()


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: later jobs neither recompute it nor lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def released(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames that ``cut`` has written and nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            removed(df.sparkSession, file.get())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column, salt: int = 0) -> Column:
    """A 64-bit hash of a text that keeps null and the empty text apart."""
    return F.xxhash64(F.lit(salt), text.isNull(), text)


def range_numbered(df: DataFrame, *order: str) -> DataFrame:
    """Sort by ``order`` over all partitions and add ``part`` and ``idx``, the place of a row inside its part.

    (part, idx) follows the order. The rows, which are to be narrow, are written before they are sampled for the range
    bounds, so that what they are computed from is read once. The result is checkpointed, because a second evaluation
    could place rows otherwise. No part holds more than a range partition.
    """
    ordered = cut(df).repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    return cut(ordered.withColumn("_row", row)).select(
        *df.columns, F.shiftright("_row", 33).alias("part"), F.col("_row").bitwiseAND((1 << 33) - 1).alias("idx")
    )


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position``: the place of each row, from 0, in the order over all rows.

    The counts that shift each part are as many rows as the sort has partitions, so they are broadcast.
    """
    from pyspark.sql import Window

    numbered = range_numbered(df, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), "part").withColumn("position", F.col("_start") + F.col("idx")).drop("part", "idx", "_start")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once an application."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    file = Path(tempfile.mkdtemp(prefix="code-")) / "llm_code.zip"
    with zipfile.ZipFile(file, "w") as z:
        for module in sorted(here.glob("*.py")):
            z.write(module, f"{here.name}/{module.name}")
    context.addPyFile(str(file))
    _shipped.add(context.applicationId)
