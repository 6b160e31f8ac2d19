"""Messages and files that leave the engine, and what repeated deliveries of a file do to its ledger row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.functions.validation import LAB_COLUMNS, number
from pulsegrid.operators.tables import resolve



def lab_events(rows: DataFrame, schema_version: int = 1) -> DataFrame:
    """(key, value) messages of valid lab rows: cells trimmed, the test in upper case, the result as a number."""
    cells = {c: F.trim(F.col(c).cast("string")) for c in LAB_COLUMNS}
    cells["test_type"] = F.upper(cells["test_type"])
    cells["result_value"] = number(cells["result_value"])
    body = F.struct(*[x.alias(c) for c, x in cells.items()], F.lit(schema_version).alias("schema_version"), "source_file", F.col("file_day").cast("string").alias("file_day"), "row_number")
    return rows.where(F.size("error_reasons") == 0).select(cells["patient_id"].alias("key"), F.to_json(body).alias("value"))


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Dead letters of rejected lab rows; the origin is file and row."""
    row = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in LAB_COLUMNS]))
    return rows.where(F.size("error_reasons") > 0).select(
        F.lit("labs").alias("source"), F.concat_ws(":", "source_file", "row_number").alias("origin"), "error_reasons", row.alias("raw_payload"), F.lit("batch").alias("detected_by")
    )


def dead_letter_table(letters: DataFrame, order: str = "detected_at") -> DataFrame:
    """One row a (source, origin): the first that came stays, a replay adds nothing."""
    return resolve(letters.withColumn("_at", F.col(order)), ["source", "origin"], ["_at"], first=True).drop("_at")


#: Deliveries of a day that are scanned together, by ``seq``.
BLOCK = 4096


def deliveries(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each delivery (file_day, seq, checksum, decision, and ``origin`` for equal seq) does: ``outcome``.

    Once a day is loaded only another good file replaces it, so the ledger row before a delivery is the last good one
    before it. Equal content is a ``duplicate``; a bad file after a loaded one is ``quarantined_file_only`` and leaves
    the row as it is; else the ledger takes the decision. Days of any number of deliveries are scanned in blocks of seq:
    the last good one of each block is carried into the next ones, and within a block a window looks back.
    """
    turn = ["seq", *(c for c in ("origin",) if c in files.columns)]
    good = F.col("decision") == "loaded"
    dealt = files.withColumn("_block", F.floor(F.col("seq") / block))
    last = dealt.where(good).groupBy("file_day", "_block").agg(F.max_by("checksum", F.struct(*turn)).alias("_last"))
    ahead = Window.partitionBy("file_day").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.select("file_day", "_block").distinct().join(last, ["file_day", "_block"], "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(ahead))
    before = Window.partitionBy("file_day", "_block").orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(blocks.select(F.col("file_day").alias("_day"), F.col("_block").alias("_of"), "_carried"), F.col("file_day").eqNullSafe(F.col("_day")) & (F.col("_block") == F.col("_of")))
    loaded = F.coalesce(F.last(F.when(good, F.col("checksum")), ignorenulls=True).over(before), "_carried")
    outcome = F.when(loaded == F.col("checksum"), "duplicate").when(~good & loaded.isNotNull(), "quarantined_file_only").otherwise(F.col("decision"))
    return joined.withColumn("outcome", outcome).select(*files.columns, "outcome")


def labs_ready(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Days with ``ready``: the table holds as many rows as the ledger counts, or the day isn't loaded."""
    have = stored.groupBy("file_day").agg(F.count("*").alias("stored"))
    joined = ledger.join(have, "file_day", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return joined.select("file_day", "stored", ((F.col("status") != "loaded") | (F.col("stored") >= F.col("rows_valid"))).alias("ready"))


def significant(value: Column, digits: int = 6) -> Column:
    """A number's text with so many digits and no trailing zeros, for magnitudes from 0.001 to 10 million.

    Halves as a double has them, up to its own error, round away from zero.
    """
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, "0").otherwise(F.regexp_replace((F.round(value * scale) / scale).cast("string"), r"\.0$", ""))


def latest_results(windows_with_labs: DataFrame) -> DataFrame:
    """(patient_id, window_start, labs): the latest result of each test as an array by test, with value, unit, range, flag and time."""
    newest = F.max(F.struct("collected_at", "sample_id", "result_value", "reference_range", "unit")).alias("r")
    each = windows_with_labs.groupBy("patient_id", "window_start", "test_type").agg(newest)
    flag = rules.abnormal_flag(F.col("r.result_value"), rules.reference_range(F.col("r.reference_range")))
    entry = F.struct("test_type", F.col("r.result_value").alias("value"), "r.unit", F.col("r.reference_range").alias("range"), flag.alias("flag"), "r.collected_at")
    return each.groupBy("patient_id", "window_start").agg(F.sort_array(F.collect_list(entry)).alias("labs"))  # a row a test


def labs_map(labs: Column) -> Column:
    """The latest results as a map by test."""
    value = lambda x: F.struct(x["value"].alias("value"), x["unit"].alias("unit"), x["range"].alias("range"), x["flag"].alias("flag"), x["collected_at"].alias("collected_at"))
    return F.map_from_entries(F.transform(labs, lambda x: F.struct(x["test_type"], value(x))))


def labs_text(labs: Column) -> Column:
    """``TEST=v(H); ...`` of a map of latest results, in the order of the tests; normal results carry no flag."""
    one = lambda x: F.concat(x["key"], F.lit("="), significant(x["value"]["value"]), F.when(x["value"]["flag"] == "N", "").otherwise(F.concat(F.lit("("), x["value"]["flag"], F.lit(")"))))
    return F.array_join(F.transform(F.array_sort(F.map_entries(labs), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), one), "; ")


def report_csv(report: DataFrame) -> DataFrame:
    """The report as cells: ``lab_flags`` joined by a pipe and ``labs`` as text in ``labs_latest``."""
    text = F.coalesce(labs_text(F.col("labs")), F.lit(""))
    return report.withColumns({"lab_flags": F.array_join("lab_flags", "|"), "labs_latest": text}).drop("labs")


def write_report_csv(report: DataFrame, path: str) -> None:
    """One CSV file of a day's report, in its order; Spark's commit replaces the folder as a whole."""
    report_csv(report).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
