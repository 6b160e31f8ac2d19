"""Structured Streaming wiring of the same operators, with keyed logs as sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.validation import dead_letters, parse_dead_letters, parse_labs, parse_vitals, valid_vitals
from pulsegrid.operators import delivery, tables, windows
from pulsegrid.streaming import logs

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


#: Messages in a batch at most, and where a stream begins.
BROKER = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": "20000", "failOnDataLoss": "false"}


def configure(spark: SparkSession) -> None:
    """Keep the state of streams in bounded native memory."""
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)


def broker(spark: SparkSession, topic: str, servers: str, **options) -> DataFrame:
    """A topic from its beginning on, in bounded batches; offsets that the broker has dropped don't end the stream."""
    return source(spark, "kafka", **BROKER | {"subscribe": topic, "kafka.bootstrap.servers": servers} | options)


def publisher(fmt: str, path: str | None = None, **options) -> Callable[[DataFrame], None]:
    """A topic sink for (key, value, topic) messages; a broker format routes by ``topic``, tests name a folder of files."""

    def publish(messages: DataFrame) -> None:
        writer = messages.write.format(fmt).mode("append").options(**options)
        writer.save(path) if path else writer.save()

    return publish


def source(spark: SparkSession, fmt: str, schema: str | None = None, path: str | None = None, **options) -> DataFrame:
    """A topic stream; production names a broker format, tests a folder of files."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path) if path else reader.load()


def deduplicated(raw: DataFrame, known: DataFrame | None, watermark: str = "30 minutes") -> DataFrame:
    """Valid readings under an event-time watermark, each event once in its bounded state."""
    return valid_vitals(parse_vitals(raw, known)).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["event_id"])


def windowed(raw: DataFrame, known: DataFrame | None, length: str = "1 hour", watermark: str = "30 minutes") -> DataFrame:
    """For update mode: open windows come again as they grow."""
    return windows.tumbling_stats(deduplicated(raw, known, watermark), length)


def trends(raw: DataFrame, known: DataFrame | None, length: str = "4 hours", slide: str = "1 hour", watermark: str = "30 minutes") -> DataFrame:
    """For append mode: each window once, complete."""
    return windows.sliding_slopes(deduplicated(raw, known, watermark), length, slide)


def rejected(raw: DataFrame, known: DataFrame | None, name: str = "vitals") -> DataFrame:
    return dead_letters(parse_vitals(raw, known).where(F.size("error_reasons") > 0), name)


def write_log(path: str, epoch: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: batch N overwrites its own folder, so that a rerun leaves the table as it was."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}/batch_id={batch_id}")

    return sink


def start(df: DataFrame, name: str, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    writer = df.writeStream.queryName(name).outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/{name}")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


LAB_LOG = "sample_id string, test_type string, patient_id string, result_value double, unit string, reference_range string, ref_low double, ref_high double, abnormal_flag string, collected_at timestamp, file_day date, source_file string"
TREND_LOG = "patient_id string, window_start timestamp, window_end timestamp, trend string"
ALERT_LOG = "patient_id string, window_start timestamp, window_end timestamp, alert_type string, severity string, observed_value double, threshold double, message string, alert_id string"


FILE_LOG = "file_day date, seq long, source_file string, event string, status string, checksum string, rows_total long, rows_valid long, rows_rejected long"


@dataclass(frozen=True)
class Table:
    """How a table's rows are told apart, which time has their day, and which of them wins."""

    key: tuple[str, ...] = ()
    at: str | None = None
    order: tuple[str, ...] = ()
    moves: bool = False


#: A table that isn't listed keeps every row.
TABLES = {
    "windows": Table(("patient_id", "window_start"), "window_start"),
    "trends": Table(("patient_id", "window_start"), "window_end"),
    "window_alerts": Table(("alert_id",), "window_start"),
    "trend_alerts": Table(("alert_id",), "window_start"),
    "lab_results": Table(("sample_id", "test_type"), "collected_at", moves=True),
    "live_status": Table(("patient_id",), None, ("window_start",)),  # a row a patient, of no day
    "dead_letters": Table((), "detected_at"),
    "latency": Table((), "processed_at"),
    "vitals_outcomes": Table((), "processed_at"),
    "labs_outcomes": Table((), "processed_at"),
    "file_ledger": Table((), "file_day"),
}


@dataclass
class Ward:
    """The five streaming queries of a ward over shared folders: tables are keyed logs under ``root``, messages go to ``publish``.

    ``known`` gives the roster anew for every batch that asks for it; the stateful queries plan the frame that it gives at
    their start anew for every batch, so that a roster read by JDBC is the present one there too. A batch writes its own
    folders again when it is replayed; what it publishes it may publish again, under the same alert id or origin.
    What a batch looks up is bounded by its own days and by the tails of the logs, not by their history.
    """

    spark: SparkSession
    root: str
    checkpoint: str
    publish: Callable[[DataFrame], None]
    known: Callable[[], DataFrame]
    epoch: int = 0
    trigger: dict = field(default_factory=lambda: {"availableNow": True})
    least_readings: int = 20
    tail: int = logs.TAIL

    def stored(self, name: str) -> logs.KeyedLog:
        own = TABLES.get(name, Table())
        return logs.KeyedLog(self.spark, f"{self.root}/{name}", own.key, own.at, own.order, own.moves, self.epoch, self.tail)

    def log(self, name: str) -> Callable[[DataFrame, int], None]:
        return self.stored(name).append

    def raise_alerts(self, alerts: DataFrame, batch_id: int, name: str) -> None:
        """Publish those that no earlier batch has stored, then store all: a crash in between publishes again and loses none.

        An alert's id fixes its window, so only the days of the batch's windows are looked through.
        """
        low, high = alerts.agg(F.to_date(F.min("window_start")), F.to_date(F.max("window_start"))).first()
        if low is not None:
            stored = self.stored(name).rows(ALERT_LOG, low, high).where(F.col("batch_id") <= batch_id)
            new = tables.new_rows(alerts, stored, "alert_id")
            self.publish(new.select(F.col("patient_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"), F.lit("alerts").alias("topic")))
        self.log(name)(alerts, batch_id)

    def score(self, batch: DataFrame) -> DataFrame:
        """The windows of a batch scored by the labs and trends of the time that they need, read as they are now."""
        low, high = batch.agg(F.min("window_start"), F.max("window_end")).first()
        labs = self.stored("lab_results").table(LAB_LOG, low - timedelta(hours=48), high)
        trends = self.stored("trends").table(TREND_LOG, low - timedelta(hours=2), high)
        return windows.window_scores(batch, windows.lab_adjustments(batch, labs), windows.latest_trend(batch, trends))

    def score_sink(self, batch: DataFrame, batch_id: int) -> None:
        """Scored windows, live status, alerts and how long after its production the newest reading was processed."""
        if batch.isEmpty():
            return
        scored = self.score(batch).persist()
        try:
            self.log("windows")(scored, batch_id)
            self.log("live_status")(tables.resolve(scored, ["patient_id"], ["window_start"]), batch_id)
            self.raise_alerts(windows.threshold_alerts(scored).unionByName(windows.risk_alerts(scored)), batch_id, "window_alerts")
            self.log("latency")(scored.agg(F.current_timestamp().alias("processed_at"), F.max("last_produced_at").alias("newest_produced_at")), batch_id)
        finally:
            scored.unpersist()

    def trend_sink(self, batch: DataFrame, batch_id: int) -> None:
        found = windows.with_trend(batch, self.least_readings).persist()
        try:
            self.log("trends")(found, batch_id)
            self.raise_alerts(windows.trend_alerts(found), batch_id, "trend_alerts")
        finally:
            found.unpersist()

    def parsed_sink(self, parse: Callable[[DataFrame, DataFrame], DataFrame], source_name: str, keep: str | None) -> Callable[[DataFrame, int], None]:
        """Outcomes counted, rejected rows to the dead letters, and the valid ones to the table ``keep``."""

        def sink(batch: DataFrame, batch_id: int) -> None:
            rows = parse(batch, self.known()).persist()
            try:
                good = F.size("error_reasons") == 0
                self.log(f"{source_name}_outcomes")(rows.groupBy(F.when(good, "valid").otherwise(F.get("error_reasons", F.lit(0))).alias("outcome")).agg(F.count("*").alias("n"), F.current_timestamp().alias("processed_at")), batch_id)
                self.publish(dead_letters(rows.where(~good), source_name).withColumn("topic", F.lit("deadletter")))
                if keep:
                    self.log(keep)(rows.where(good).drop("error_reasons", "raw_payload", "origin"), batch_id)
            finally:
                rows.unpersist()

        return sink

    def letter_sink(self, batch: DataFrame, batch_id: int) -> None:
        self.log("dead_letters")(parse_dead_letters(batch.select(F.col("value").cast("string").alias("value"))), batch_id)

    def file_sink(self, batch: DataFrame, batch_id: int) -> None:
        """Publish the rows of files that are to be loaded, valid and rejected ones in one frame of two topics, then write the ledger.

        What a file does is decided before anything is published, by the ledger of its day and the files of the batch before
        it: one with the content of the loaded one is a duplicate, and a bad one after a good one leaves the day as it is. The
        stream's checkpoint marks the files only after all, so that a crash replays them: the ledger of this batch is not
        looked at then, and decisions are the same again.
        """
        rows = tables.csv_rows(batch).persist()
        try:
            checked = tables.checked_rows(rows, self.known())
            days = rows.agg(F.min("file_day"), F.max("file_day")).first()
            before = self.stored("file_ledger").rows(FILE_LOG, *days) if days[0] else self.spark.createDataFrame([], f"{FILE_LOG}, batch_id long")
            loaded_before = before.where((F.col("batch_id") < batch_id) & (F.col("event") == "result") & (F.col("status") == "loaded"))
            checks = tables.file_checks(rows, checked).withColumnRenamed("status", "decision")
            held = loaded_before.groupBy("file_day").agg(F.max_by("checksum", "seq").alias("checksum")).withColumns({"seq": F.lit(-1).cast("long"), "decision": F.lit("loaded"), "origin": F.lit("")})
            both = checks.select("file_day", "checksum", "seq", "decision", "origin").unionByName(held)
            decided = delivery.deliveries(both).where("seq >= 0").select("origin", "outcome")
            found = checks.join(decided, "origin").persist()
            loaded = checked.join(found.where("outcome = 'loaded'").select("origin"), "origin", "left_semi")
            letters = delivery.rejected_rows(loaded)
            bad = letters.select(F.lit("labs").alias("key"), F.to_json(F.struct(*letters.columns)).alias("value"), F.lit("deadletter").alias("topic"))
            self.publish(delivery.lab_events(loaded).withColumn("topic", F.lit("labs.raw")).unionByName(bad))
            event = F.when(F.col("outcome").isin("loaded", "quarantined"), "result").otherwise(F.col("outcome"))
            ledger = found.withColumns({"event": event, "status": F.col("decision")}).select(*[c.split()[0] for c in FILE_LOG.split(", ")])
            self.log("file_ledger")(ledger, batch_id)
            found.unpersist()
        finally:
            rows.unpersist()

    def receive(self, folder: str) -> int:
        """Move the waiting lab files of a folder to this ward's inbox, each to a folder of its own, so that a name can come again.

        A delivery's folder is named by when the file came, and its day's deliveries are taken in that order. Files are renamed,
        one a lab day or so; what another process has moved meanwhile is left to it.
        """
        landing, moved = logs.Folder(self.spark, folder), 0
        for name in sorted(n for n in landing.names() if n.startswith("labs_") and n.endswith(".csv")):
            moved += landing.move(name, f"{self.inbox}/{landing.modified(name):013d}-{uuid.uuid4().hex}/{name}")
        return moved

    @property
    def inbox(self) -> str:
        return f"{self.root}/inbox"

    def start_files(self, folder: str) -> StreamingQuery:
        """Every lab file that waits in a folder; deliveries under a name that came before are deliveries of their own."""
        self.receive(folder)
        files = self.spark.readStream.format("binaryFile").schema(tables.FILE_SCHEMA).option("pathGlobFilter", "labs_*.csv").option("recursiveFileLookup", "true").load(self.inbox)
        return start(files, "lab_files", self.file_sink, self.checkpoint, trigger=self.trigger)

    def file_ledger(self) -> DataFrame:
        """The ledger as it is now, a row a file day."""
        return tables.ledger_state(self.stored("file_ledger").table(FILE_LOG))

    def start(self, vitals: DataFrame, labs: DataFrame, letters: DataFrame) -> list[StreamingQuery]:
        """All queries in one session; each goes on where its checkpoint ends."""
        configure(self.spark)
        known = self.known()
        return [
            start(vitals, "quality", self.parsed_sink(parse_vitals, "vitals", None), self.checkpoint, trigger=self.trigger),
            start(labs, "labs", self.parsed_sink(parse_labs, "labs", "lab_results"), self.checkpoint, trigger=self.trigger),
            start(trends(vitals, known), "trends", self.trend_sink, self.checkpoint, trigger=self.trigger),
            start(windowed(vitals, known), "windows", self.score_sink, self.checkpoint, "update", self.trigger),
            start(letters, "dead_letters", self.letter_sink, self.checkpoint, trigger=self.trigger),
        ]


def await_all(queries: list[StreamingQuery]) -> None:
    """Until every query has ended; one that fails stops the others and raises."""
    try:
        while any(q.isActive for q in queries):
            next(q for q in queries if q.isActive).awaitTermination(1)
            for q in queries:
                if (failure := q.exception()) is not None:
                    raise failure
        for q in queries:
            if (failure := q.exception()) is not None:
                raise failure
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


def latency_seconds(log: DataFrame) -> DataFrame:
    """(batch_id, latency) from the newest reading's production to its processing."""
    return log.select("batch_id", ((F.unix_micros("processed_at") - F.unix_micros("newest_produced_at")) / 1e6).alias("latency"))
