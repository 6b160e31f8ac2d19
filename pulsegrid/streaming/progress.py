"""Progress of streaming queries as a table, and what is derived from it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "name string, batch_id long, at timestamp, input_rows long, input_rate double, process_rate double, batch_ms long, dropped long, state_rows long, watermark timestamp, sources array<struct<latest: string, end: string>>"
_OFFSETS = "map<string, map<string, bigint>>"


def lag(latest: Column, end: Column) -> Column:
    """Messages between two offsets in JSON, summed over topics and partitions; a partition without an end offset counts 0."""
    ends = F.from_json(end, _OFFSETS)

    def partitions(topic: Column) -> Column:
        behind = lambda p: F.greatest(p["value"] - F.coalesce(ends[topic["key"]][p["key"]], p["value"]), F.lit(0).cast("long"))
        return F.aggregate(F.map_entries(topic["value"]), F.lit(0).cast("long"), lambda n, p: n + behind(p))

    topics = F.map_entries(F.from_json(latest, _OFFSETS))
    return F.coalesce(F.aggregate(topics, F.lit(0).cast("long"), lambda n, t: n + partitions(t)), F.lit(0).cast("long"))


def source_lag(progress: DataFrame) -> DataFrame:
    """``progress`` with ``lag``, summed over the sources of a query."""
    total = F.aggregate(F.col("sources"), F.lit(0).cast("long"), lambda n, s: n + lag(s["latest"], s["end"]))
    return progress.withColumn("lag", F.coalesce(total, F.lit(0).cast("long")))


def progress_row(progress: dict) -> dict:
    """One row of SCHEMA, but for times as text, of a query's progress as Spark reports it."""
    states = progress.get("stateOperators") or []
    return {
        "name": progress.get("name") or "unnamed",
        "batch_id": progress.get("batchId"),
        "at": progress.get("timestamp"),
        "input_rows": progress.get("numInputRows") or 0,
        "input_rate": progress.get("inputRowsPerSecond"),
        "process_rate": progress.get("processedRowsPerSecond"),
        "batch_ms": (progress.get("durationMs") or {}).get("triggerExecution", 0),
        "dropped": sum(s.get("numRowsDroppedByWatermark", 0) for s in states),
        "state_rows": sum(s.get("numRowsTotal", 0) for s in states),
        "watermark": (progress.get("eventTime") or {}).get("watermark"),
        "sources": [{k: json.dumps(s.get(f"{k}Offset")) if isinstance(s.get(f"{k}Offset"), dict) else s.get(f"{k}Offset") for k in ("latest", "end")} for s in progress.get("sources") or []],
    }


class ProgressLog(StreamingQueryListener):
    """Appends each query's progress to a table of JSON lines at ``path``, through Spark's writer, ``rows`` batches at a time
    and when a query ends."""

    def __init__(self, spark: SparkSession, path: str, rows: int = 100) -> None:
        self._spark, self._path, self._rows = spark, path, rows
        self._held: list[tuple[str]] = []

    def flush(self) -> None:
        held, self._held = self._held, []
        if held:
            self._spark.createDataFrame(held, "value string").coalesce(1).write.mode("append").text(self._path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._held.append((json.dumps(progress_row(json.loads(event.progress.json))),))
        if len(self._held) >= self._rows:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def late_share(progress: DataFrame) -> DataFrame:
    """(name, rows, dropped, share): the rows that each query dropped behind its watermark."""
    sums = progress.groupBy("name").agg(F.sum("input_rows").alias("rows"), F.sum("dropped").alias("dropped"))
    return sums.withColumn("share", F.coalesce(F.try_divide(F.col("dropped").cast("double"), F.col("rows").cast("double")), F.lit(0.0)))
