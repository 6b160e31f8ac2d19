"""Daily features and the consolidated report, for all days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import rules

EXTREMES = {"heart_rate_max": F.max, "spo2_min": F.min, "systolic_bp_min": F.min, "temperature_max": F.max}
COUNTS = ("windows", "readings", "hours_high", "hours_medium", "deteriorating_windows", "alerts_critical", "alerts_high", "alerts_medium")
#: The columns of the report, in order.
COLUMNS = (
    "report_date", "patient_id", "bed", "windows", "readings", "ews_peak", "hours_high", "hours_medium", "heart_rate_max", "spo2_min", "systolic_bp_min", "temperature_max", "last_trend", "deteriorating_windows", "max_index",
    "alerts_critical", "alerts_high", "alerts_medium", "labs", "labs_status", "ews_end", "red_flag", "trend_adjustment", "vitals_score", "total_score", "lab_adjustment", "lab_flags", "vitals_only_tier", "risk_tier", "tier_change",
)


def daily_vitals(scores: DataFrame, day: Column, tail_hours: int = 4) -> DataFrame:
    """Counts, peaks and extremes of a patient's windows in a day, and averages of the day's last hours weighted by readings."""
    ends = day.cast("timestamp") + F.expr(f"interval {24 - tail_hours} hours")
    n = F.when(F.col("window_start") >= ends, F.col("n_readings"))
    tails = [F.try_divide(F.sum(F.col(f"{v}_avg") * n), F.sum(n).cast("double")).alias(f"{v}_tail") for v in rules.BANDS]
    return scores.groupBy(day.alias("report_date"), "patient_id").agg(
        F.count("*").alias("windows"), F.sum("n_readings").alias("readings"), F.max("ews_score").alias("ews_peak"), F.count_if(F.col("risk_tier") == "HIGH").alias("hours_high"),
        F.count_if(F.col("risk_tier") == "MEDIUM").alias("hours_medium"), *[f(c).alias(c) for c, f in EXTREMES.items()], *tails,
    )


def daily_trends(trends: DataFrame, day: Column) -> DataFrame:
    known = F.col("trend") != "insufficient_data"
    return trends.groupBy(day.alias("report_date"), "patient_id").agg(
        F.count_if(F.col("trend") == "deteriorating").alias("deteriorating_windows"), F.max("deterioration_index").alias("max_index"),
        F.coalesce(F.max_by(F.when(known, F.col("trend")), F.when(known, F.col("window_end"))), F.lit("unknown")).alias("last_trend"),
    )


def daily_alerts(alerts: DataFrame, day: Column) -> DataFrame:
    return alerts.groupBy(day.alias("report_date"), "patient_id").agg(*[F.count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in ("critical", "high", "medium")])


def day_windows(days: DataFrame, patients: DataFrame) -> DataFrame:
    """A window of each day for each patient, also those without readings: both are few."""
    start = F.col("report_date").cast("timestamp")
    return days.select("report_date").crossJoin(patients.select("patient_id")).select("report_date", "patient_id", start.alias("window_start"), (start + F.expr("interval 1 day")).alias("window_end"))


def build_report(roster: DataFrame, days: DataFrame, vitals: DataFrame, trends: DataFrame, alerts: DataFrame, adjustments: DataFrame, labs: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row a day and active patient, COLUMNS and the scenario, by day and then the highest tier and score first.

    The vitals score is of the day's last hours and trend, the total one of labs, too; without windows both are null and
    the tier is NO_DATA. ``ledger`` has file_day, status and arrival, at most a row a day.
    """
    keys = ["report_date", "patient_id"]
    base = day_windows(days, roster.where("active")).select(*keys).join(roster.select("patient_id", "bed", "scenario"), "patient_id")
    joined = base
    for part in (vitals, trends, alerts, adjustments, labs):
        joined = joined.join(part, keys, "left")
    came = ledger.select(F.col("file_day").alias("report_date"), F.concat_ws("/", "status", "arrival").alias("labs_status"))
    joined = joined.join(came, "report_date", "left")
    have = F.col("windows").isNotNull()
    score, red = rules.early_warning({v: F.col(f"{v}_tail") for v in rules.BANDS})
    first = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNTS} | {
        "have": have, "ews_end": F.when(have, score), "red_flag": have & red, "last_trend": F.coalesce("last_trend", F.lit("unknown")), "lab_adjustment": F.coalesce("lab_adjustment", F.lit(0)),
        "lab_flags": F.coalesce("lab_flags", F.array().cast("array<string>")), "labs_status": F.coalesce("labs_status", F.lit("not_received")),
    })
    scored = first.withColumn("trend_adjustment", (F.col("have") & (F.col("last_trend") == "deteriorating")).cast("int")).withColumn("vitals_score", F.col("ews_end") + F.col("trend_adjustment"))
    scored = scored.withColumn("total_score", (F.col("vitals_score") + F.col("lab_adjustment")).cast("int"))
    named = scored.withColumns({name: F.when(F.col("have"), rules.tier(F.col(c), F.col("red_flag"))).otherwise("NO_DATA") for name, c in (("vitals_only_tier", "vitals_score"), ("risk_tier", "total_score"))})
    higher = rules.tier_rank(F.col("risk_tier")) > rules.tier_rank(F.col("vitals_only_tier"))
    done = named.withColumn("tier_change", F.when(~F.col("have"), "no_data").when(higher, "escalated").otherwise("unchanged"))
    return done.select(*COLUMNS, "scenario").orderBy("report_date", F.desc(rules.tier_rank(F.col("risk_tier"))), F.desc_nulls_last("total_score"), "patient_id")


def write_report(report: DataFrame, path: str) -> None:
    """Replace the days of ``report`` in the table at ``path``, whose partitions are days; other days stay."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)


def report_summary(report: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("risk_tier") == t).alias(f"tier_{t.lower()}") for t in rules.TIERS]
    return report.groupBy("report_date").agg(F.count("*").alias("patients"), *counts, F.count_if(F.col("tier_change") == "escalated").alias("escalated"), F.sum(F.col("alerts_critical") + F.col("alerts_high") + F.col("alerts_medium")).alias("alerts_total"), F.count_if(F.col("last_trend") == "deteriorating").alias("deteriorating"))
