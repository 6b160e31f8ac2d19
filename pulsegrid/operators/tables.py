"""Keyed tables as logs resolved on read, rosters, ledgers and file checks."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.validation import LAB_COLUMNS, lab_errors


def materialised(df: DataFrame) -> DataFrame:
    """``df``, computed once for all that follows: in the shared checkpoint folder where the session has one, else in the executors' storage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None and folder:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def resolve(log: DataFrame, key: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row a key: the last by ``order`` (last write wins), or the first (insert if absent). Partial aggregates combine before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    pick = F.min_by if first else F.max_by
    return log.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def touched(log: DataFrame, key: Sequence[str], order: Sequence[str], at: str) -> DataFrame:
    """As ``resolve`` with last write wins, and when each key was first and last seen, by ``at``."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")).select(*key, "_r.*", "first_seen", "last_seen")


def newest_epoch(log: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row a key of a log of batches: the last by ``order`` and batch of the newest epoch; a reprocessing is an epoch."""
    newest = log.agg(F.max("epoch").alias("epoch"))
    return resolve(log.join(F.broadcast(newest), "epoch"), key, [*order, "batch_id"]).drop("epoch", "batch_id")  # one row


def new_rows(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return candidates.join(known.select(key), key, "left_anti")


def roster_sync(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The roster after a snapshot: listed patients are upserted, others deactivated."""
    s = snapshot.select("patient_id", F.col("bed").alias("_bed"), F.lit(True).alias("_listed"))
    joined = current.join(s, "patient_id", "full_outer")
    return joined.select("patient_id", F.coalesce("_bed", "bed").alias("bed"), F.coalesce("_listed", F.lit(False)).alias("active"))


def ledger_state(events: DataFrame) -> DataFrame:
    """One row a file day from its events (seq, event, status, rows_valid): counts replaced, deliveries summed, duplicates counted, and missing marks that never downgrade another status."""
    real = F.col("event") == "result"
    return events.groupBy("file_day").agg(
        F.coalesce(F.max_by(F.when(real, F.col("status")), F.when(real, F.col("seq"))), F.lit("missing")).alias("status"),
        F.coalesce(F.max_by(F.when(real, F.col("rows_valid")), F.when(real, F.col("seq"))), F.lit(0)).cast("long").alias("rows_valid"),
        F.count_if(real).alias("deliveries"),
        F.count_if(F.col("event") == "duplicate").alias("duplicate_deliveries"),
    )


def file_duplicates(rows: DataFrame, file: str = "source_file") -> DataFrame:
    """Rows without an error that repeat (sample_id, test_type) of an earlier valid row of their file get ``duplicate_row``."""
    from pyspark.sql import Window

    valid = F.size("error_reasons") == 0
    nth = F.row_number().over(Window.partitionBy(file, F.trim("sample_id"), F.upper(F.trim("test_type")), valid).orderBy("row_number"))
    return rows.withColumn("error_reasons", F.when(valid & (nth > 1), F.array(F.lit("duplicate_row"))).otherwise(F.col("error_reasons")))


def file_stats(rows: DataFrame, file: str = "source_file") -> DataFrame:
    """Rows, valid and rejected rows and the reject rate of each file; an empty file has rate 1."""
    valid = F.count_if(F.size("error_reasons") == 0)
    total = F.count("*")
    return rows.groupBy(file).agg(total.alias("rows_total"), valid.alias("rows_valid"), (total - valid).alias("rows_rejected"), F.coalesce(F.try_divide((total - valid).cast("double"), total.cast("double")), F.lit(1.0)).alias("reject_rate"))


def reject_reasons(rows: DataFrame) -> DataFrame:
    """(source_file, reason, n): the rejected rows of each file by their first reason."""
    first = F.get("error_reasons", F.lit(0))
    return rows.where(first.isNotNull()).groupBy("source_file", first.alias("reason")).agg(F.count("*").alias("n"))


def file_decision(stats: DataFrame, limit: float = 0.2) -> DataFrame:
    return stats.withColumn("status", F.when((F.col("rows_total") == 0) | (F.col("reject_rate") > limit), "quarantined").otherwise("loaded"))


def file_day(name: Column) -> Column:
    return F.try_to_date(F.regexp_extract(name, r"^labs_(\d{4}-\d{2}-\d{2})\.csv$", 1), "yyyy-MM-dd")


def arrival(day: Column, arrived: Column, hour: int = 6, grace_hours: int = 1) -> Column:
    expected = F.date_add(day, 1).cast("timestamp") + F.expr(f"interval {hour} hours")
    return F.when(arrived <= expected + F.expr(f"interval {grace_hours} hours"), "on_time").otherwise("late")


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def waiting_files(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "labs_*.csv").load(folder)


def _records(text: Column) -> Column:
    """The records of a CSV text as arrays of cells; blank ones after the header are none.

    A text without a quote is split by line ends and commas. In others a cell that begins with a quote can hold commas, line
    ends and doubled quotes, so these are read in order, by one pass over the file.
    """

    @F.udf("array<array<string>>")
    def read(quoted: str | None) -> list[list[str]] | None:
        if quoted is None:
            return None
        csv.field_size_limit(1 << 31 - 1)
        found = csv.reader(io.StringIO(quoted, newline=""))
        return [record for i, record in enumerate(found) if record or not i]

    has_quote = F.contains(text, F.lit('"'))
    lines = F.split(text, "\r\n|\r|\n")
    plain = F.transform(F.filter(lines, lambda x, i: (x != "") | (i == 0)), lambda x: F.split(x, ","))
    return F.when(has_quote, read(F.when(has_quote, text))).otherwise(plain)


def csv_rows(files: DataFrame) -> DataFrame:
    """(source_file, file_day, checksum, good_header, origin, seq, row_number, the cells by name, wrong_count) of lab files.

    ``origin`` is the delivery's path and ``seq`` when it came, in milliseconds. Rows are numbered from 1 as data records;
    blank ones are none, and a quoted cell may hold line ends. A row with more cells than the header has ``wrong_count``;
    one with fewer lacks the last ones. Files that can't be decoded or whose name or header is another give one row
    without number and cells.
    """
    name = F.element_at(F.split("path", "/"), -1)
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    base = files.select(name.alias("source_file"), file_day(name).alias("file_day"), F.sha2("content", 256).alias("checksum"), F.col("path").alias("origin"), F.unix_millis("modificationTime").alias("seq"), _records(text).alias("records"))
    header = F.array(*map(F.lit, LAB_COLUMNS))
    good = F.coalesce(F.get("records", F.lit(0)) == header, F.lit(False)) & F.col("file_day").isNotNull()
    named = ["source_file", "file_day", "checksum", "good_header", "origin", "seq"]
    rows = base.withColumn("good_header", good).select(*named, F.posexplode_outer(F.when(good, F.slice("records", 2, 1 << 30))).alias("at", "cells"))
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(LAB_COLUMNS)]
    wrong = F.coalesce(F.size("cells") > len(LAB_COLUMNS), F.lit(False))
    return rows.select(*named, (F.col("at") + 1).alias("row_number"), *cells, wrong.alias("wrong_count"))


def checked_rows(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The numbered rows of files with ``error_reasons``: their count of cells, else the contract, else repeats in the file."""
    coded = lab_errors(rows.where("row_number is not null"), known)
    wrong = F.when(F.col("wrong_count"), F.array(F.lit("wrong_column_count"))).otherwise(F.col("error_reasons"))
    return file_duplicates(coded.withColumn("error_reasons", wrong), "origin")


def file_checks(rows: DataFrame, checked: DataFrame, limit: float = 0.2) -> DataFrame:
    """One row a delivered file: day, checksum, header, counts and status; one with another header or without rows is quarantined."""
    files = rows.select("source_file", "file_day", "checksum", "good_header", "origin", "seq").distinct()
    stats = files.join(file_stats(checked, "origin"), "origin", "left")
    counted = stats.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows_total", "rows_valid", "rows_rejected")} | {"reject_rate": F.coalesce("reject_rate", F.lit(1.0))})
    return file_decision(counted, limit)
