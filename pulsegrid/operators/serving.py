"""Serving views, task and file ledgers, alert acknowledgements and the simulated clock."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.tables import resolve


@dataclass(frozen=True)
class SimClock:
    """A simulated day lasts ``day_seconds``; both anchors are the same moment; time stands still from ``paused`` on."""

    anchor_sim: Column
    anchor_real: Column
    day_seconds: float
    paused: Column | None = None

    def to_sim(self, real: Column) -> Column:
        seen = real if self.paused is None else F.least(real, self.paused)
        passed = F.unix_micros(seen) - F.unix_micros(self.anchor_real)
        return F.timestamp_micros(F.unix_micros(self.anchor_sim) + F.round(passed * (86400 / self.day_seconds)).cast("long"))

    def to_real(self, sim: Column) -> Column:
        passed = F.unix_micros(sim) - F.unix_micros(self.anchor_sim)
        return F.timestamp_micros(F.unix_micros(self.anchor_real) + F.round(passed / (86400 / self.day_seconds)).cast("long"))


def task_runs(log: DataFrame) -> DataFrame:
    """One row a (dag, run, task, try), the last by ``seq``, with its duration and at most 500 characters of its error."""
    last = resolve(log, ["dag_id", "run_id", "task_id", "try_number"], ["seq"])
    return last.withColumns({
        "duration_s": (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6,
        "error": F.substring("error", 1, 500),
    })


def last_durations(runs: DataFrame) -> DataFrame:
    """The duration of the last ended run of each (dag, task)."""
    ended = runs.where("duration_s is not null").select("dag_id", "task_id", "ended_at", "run_id", "try_number", "duration_s")
    return resolve(ended, ["dag_id", "task_id"], ["ended_at", "run_id", "try_number"])


def failed_tasks(runs: DataFrame, since: Column) -> DataFrame:
    return runs.where((F.col("state") == "failed") & (F.col("ended_at") > since)).groupBy("dag_id", "task_id").agg(F.count("*").alias("failed"))


def scheduled(day: Column, hour: int = 6) -> Column:
    """When the file of a day is due: the next day at ``hour``."""
    return F.date_add(day, 1).cast("timestamp") + F.expr(f"interval {hour} hours")


def received(ledger: DataFrame) -> DataFrame:
    """Days whose file has come; a quarantined one counts."""
    return ledger.where(F.col("status").isin("loaded", "quarantined")).select("file_day")


def missing_days(days: DataFrame, ledger: DataFrame, now: Column, hour: int = 6, sla_hours: int = 4) -> DataFrame:
    """Days (``file_day``) without a received file whose deadline has passed."""
    overdue = days.where(now > scheduled(F.col("file_day"), hour) + F.expr(f"interval {sla_hours} hours"))
    return overdue.join(received(ledger), "file_day", "left_anti")


def overdue(moments: DataFrame, ledger: DataFrame, hour: int = 6, sla_hours: int = 4, late_hours: int = 2) -> DataFrame:
    """``moments`` (``now``) with the hours that the file of the day before is late, 0 if received, whether that is past its
    limit, and whether it is late but not past it."""
    asked = moments.withColumn("file_day", F.date_sub(F.to_date("now"), 1))
    come = received(ledger).distinct().withColumn("_come", F.lit(True))
    passed = (F.unix_micros("now") - F.unix_micros(scheduled(F.col("file_day"), hour))) / 3.6e9
    late = F.when(F.col("_come"), 0.0).otherwise(F.greatest(passed, F.lit(0.0)))
    return asked.join(come, "file_day", "left").select("now", "file_day", (late > sla_hours).cast("int").alias("overdue"), F.round(late, 2).alias("hours_late"), ((late > late_hours) & (late <= sla_hours)).alias("late"))


def filtered(alerts: DataFrame, patient_id: str | None = None, severities=None, alert_types=None, since: Column | None = None, acknowledged: bool | None = None) -> DataFrame:
    """Alerts that meet those of the filters that are given."""
    wanted = []
    if patient_id is not None:
        wanted.append(F.col("patient_id") == patient_id)
    if severities is not None:
        wanted.append(F.col("severity").isin(*severities))
    if alert_types is not None:
        wanted.append(F.col("alert_type").isin(*alert_types))
    if since is not None:
        wanted.append(F.col("window_start") >= since)
    if acknowledged is not None:
        wanted.append(F.col("acknowledged") == acknowledged)
    return alerts.where(F.expr("true") if not wanted else reduce(Column.__and__, wanted))


def acknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their last acknowledgement; the acknowledgements are a log of their own, so a re-raised alert keeps its one."""
    last = resolve(acks.select("alert_id", "acknowledged_at", "acknowledged_by"), ["alert_id"], ["acknowledged_at", "acknowledged_by"])
    return alerts.join(last, "alert_id", "left").withColumn("acknowledged", F.col("acknowledged_at").isNotNull())


def patient_detail(patients: DataFrame, labs: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Patients with their open alerts and, a row each, their latest results and whether these still count."""
    latest = resolve(labs.select("patient_id", "test_type", "collected_at", "sample_id", "result_value"), ["patient_id", "test_type"], ["collected_at", "sample_id", "result_value"])
    tests = latest.select("patient_id", "test_type", (F.col("collected_at") > now - F.expr("interval 48 hours")).alias("counts_toward_score"))
    open_alerts = alerts.where("not acknowledged").groupBy("patient_id").agg(F.count("*").alias("active_alerts"))
    joined = patients.join(open_alerts, "patient_id", "left").join(tests, "patient_id", "left")
    return joined.withColumn("active_alerts", F.coalesce("active_alerts", F.lit(0)))


def report_envelope(report: DataFrame) -> DataFrame:
    """Each day's count of patients by tier, as a map, how many labs escalated, and the newest ``generated_at``."""
    tiers = report.groupBy("report_date", "risk_tier").agg(F.count("*").alias("n"), F.count_if(F.col("tier_change") == "escalated").alias("up"), F.max("generated_at").alias("at"))
    entries = F.sort_array(F.collect_list(F.struct("risk_tier", "n")))  # a row a tier
    return tiers.groupBy("report_date").agg(F.map_from_entries(entries).alias("tiers"), F.sum("up").alias("escalated_by_labs"), F.sum("n").alias("patients"), F.max("at").alias("generated_at"))


def lab_effect(report: DataFrame) -> DataFrame:
    """How labs changed the tiers of the latest report, and by which flags; the most endangered first."""
    latest = report.join(report.agg(F.max("report_date").alias("report_date")), "report_date", "left_semi")
    change = F.when(F.col("tier_change") == "escalated", "↑ raised by labs").otherwise("")  # fixed value: the dashboard's text
    urgency = F.when(F.col("risk_tier") == "HIGH", 0).when(F.col("risk_tier") == "MEDIUM", 1).otherwise(2)
    ordered = latest.orderBy(urgency, F.desc_nulls_last("total_score"), "patient_id")
    return ordered.select("patient_id", "vitals_only_tier", "risk_tier", change.alias("change"), "total_score", F.array_join("lab_flags", ", ").alias("lab_flags"))


def ward_summary(roster: DataFrame, live: DataFrame, alerts: DataFrame, ledger: DataFrame, report: DataFrame, now: Column, active_since: Column) -> DataFrame:
    """One row: the ward at a glance.

    Active patients, their tiers and averages, how many deteriorate, the age of the newest reading in minutes, alerts
    since a time that nobody has acknowledged by severity, the newest lab file and the date of the latest report.
    """
    active = roster.where("active").select("patient_id")
    present = live.join(active, "patient_id", "left_semi")
    counts = lambda rows, by: F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "n"))))
    tiers = present.groupBy("risk_tier").agg(F.count("*").alias("n")).agg(counts(present, "risk_tier").alias("tiers"))
    open_ = alerts.where(~F.col("acknowledged") & (F.col("window_end") >= active_since)).groupBy("severity").agg(F.count("*").alias("n")).agg(counts(alerts, "severity").alias("active_alerts"))
    means = [F.round(F.avg(f"{v}_avg"), n).alias(a) for v, n, a in (("heart_rate", 1, "hr_avg"), ("spo2", 1, "spo2_avg"), ("systolic_bp", 1, "sbp_avg"), ("temperature", 2, "temp_avg"))]
    lag = F.round((F.unix_micros(now) - F.unix_micros(F.max("last_event_time"))) / 6e7, 1).alias("lag_minutes")
    vitals = present.agg(F.count("*").alias("patients_reporting"), *means, lag, F.count_if(F.col("trend") == "deteriorating").alias("deteriorating"))
    newest = ledger.agg(F.max(F.struct("file_day", "status", "rows_valid")).alias("latest_lab_file"))
    dates = report.agg(F.max("report_date").alias("latest_report_date"))
    out = active.agg(F.count("*").alias("patients"))
    for one in (tiers, open_, vitals, newest, dates):
        out = out.crossJoin(one)  # of one row each
    return out
