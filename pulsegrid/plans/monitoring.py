"""Counters, gauges, alerts on an evaluation grid, and the ward's summary, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import monitors, serving
from pulsegrid.plans import queries as q
from pulsegrid.plans.delivery import _progress
from pulsegrid.plans.queries import DAY, query
from pulsegrid.sources import fixtures as fx

#: The end of the given events, and the steps of evaluations.
UNTIL, HOUR = 1706659200, 3600


def _hourly(s, d):
    """(patient_id, t, n): the readings of each patient and hour with any."""
    t = F.unix_timestamp(F.date_trunc("hour", "event_time")).alias("t")
    return fx.readings(s, d).groupBy("patient_id", t).agg(F.count("*").alias("n"))


def _counters(s, d):
    """The hourly readings as a cumulative count of each patient's bedside unit, which starts anew every five days."""
    later = _hourly(s, d).withColumn("life", F.floor(F.col("t") / (5 * DAY)))
    return later.select("patient_id", "t", F.sum("n").over(Window.partitionBy("patient_id", "life").orderBy("t")).alias("v"))


_HOURLY_SQL = fx.READINGS_SQL + """,
hourly as (select patient_id, epoch(date_trunc('hour', event_time))::bigint as t, count(*) as n from readings group by 1, 2)"""
_COUNTER_SQL = _HOURLY_SQL + """,
counters as (select patient_id, t, sum(n) over (partition by patient_id, t // 432000 order by t) as v from hourly),
steps as (select *, lag(v) over (partition by patient_id order by t) as b from counters),
added as (select *, case when b is null then 0 when v < b then v else v - b end as inc from steps)"""


@query("with " + _COUNTER_SQL + """ select patient_id, t, (sum(inc) over w)::bigint as increase, round((sum(inc) over w)::double / 21600.0::double, 9) as rate
  from added window w as (partition by patient_id order by t range between 21599 preceding and current row)""")
def monitor_counter_rate(s, d):
    return monitors.increase(_counters(s, d), "patient_id", "v", 6 * HOUR).withColumn("rate", F.round("rate", 9))


@query("with " + _HOURLY_SQL + """ select patient_id, t, n - first_value(n) over (partition by patient_id order by t range between 86399 preceding and current row) as delta from hourly""")
def monitor_gauge_delta(s, d):
    return monitors.delta(_hourly(s, d), "patient_id", "n", DAY)


def _evaluation_sql(samples: str, key: str, step: int, look_back: int, condition: str, hold: int) -> str:
    """CTEs from ``samples`` (key, t, x) to ``alerts``: grid points, the last sample as of each, islands of the condition."""
    return f"""firsts as (select {key}, (ceil(min(t)::double / {step})::bigint * {step}) as f from {samples} where t <= {UNTIL} group by 1),
grid as (select {key}, unnest(generate_series(f, {UNTIL} // {step} * {step}, {step})) as t from firsts),
seen as (select g.{key}, g.t, case when g.t - s.t < {look_back} then s.x end as x, g.t - s.t >= {look_back} as absent from grid g asof join {samples} s on g.{key} = s.{key} and g.t >= s.t),
judged as (select {key}, t, coalesce({condition}, false) as holds from seen),
islands as (select *, row_number() over (partition by {key} order by t) - row_number() over (partition by {key}, holds order by t) as i from judged),
stretches as (select {key}, min(t) as pending_at, max(t) as until from islands where holds group by {key}, i),
ends as (select {key}, max(t) as e from judged group by 1),
alerts as (select {key}, pending_at, case when (ceil((pending_at + {hold})::double / {step})::bigint * {step}) <= until then (ceil((pending_at + {hold})::double / {step})::bigint * {step}) end as firing_at,
  case when until < e then until + {step} end as resolved_at from stretches join ends using ({key}))"""


@query("with " + q._SHARE_SQL + ", samples as (select patient_id, t, share > 0.05 as x from sh), " + _evaluation_sql("samples", "patient_id", HOUR, DAY, "x", 12 * HOUR) + " select * from alerts")
def monitor_invalid_alerts(s, d):
    share = monitors.trailing_share(fx.readings(s, d), "patient_id", "event_time", F.col("spo2") < 90, DAY, 0.05)
    return monitors.held_alerts(share, "patient_id", 12 * HOUR, HOUR, UNTIL, DAY)


@query("with samples as (select event_type as name, floor(epoch(ts))::bigint as t, count(*) as x from events group by 1, 2), " + _evaluation_sql("samples", "name", 600, 2 * HOUR, "absent", HOUR) + " select * from alerts")
def monitor_inactive_queries(s, d):
    return monitors.inactive_queries(_progress(s, d), UNTIL, 600, 2 * HOUR, HOUR)


@query("with " + q.ALERTS_SQL + q._ACK_SQL + "," + fx.ROSTER_SQL + "," + q._ledger_events + """,
live as (select * from (select *, row_number() over (partition by patient_id order by ws desc) as nth from scores) join roster using (patient_id) where nth = 1 and active),
led as (select file_day, coalesce(max_by(status, seq) filter (where event = 'result'), 'missing') as status, coalesce(max_by(rows_valid, seq) filter (where event = 'result'), 0)::bigint as rows_valid from (select *, 100 + seq % 50 as rows_valid from e) group by 1)
select (select count(*) from roster where active) as patients, (select string_agg(risk_tier || '=' || n, ',' order by risk_tier) from (select risk_tier, count(*) as n from live group by 1)) as tiers,
  (select string_agg(severity || '=' || n, ',' order by severity) from (select severity, count(*) as n from acked where not acknowledged and we >= timestamp '2024-01-25' group by 1)) as active_alerts,
  (select count(*) from live) as patients_reporting, (select round(avg(heart_rate_avg), 1) from live) as hr_avg, (select round(avg(temperature_avg), 2) from live) as temp_avg,
  (select round((epoch_us(timestamp '2024-01-31') - epoch_us(max(r.event_time)))::double / 6e7::double, 1) from readings r where r.patient_id in (select patient_id from roster where active)) as lag_minutes,
  (select count(*) from live where trend = 'deteriorating') as deteriorating, (select max(file_day)::varchar from led) as newest_file, (select max(ws)::date::varchar from scores) as latest_report_date""")
def ward_summary(s, d):
    stats, trends, scores = q._built(s, d)
    raised = q._raised(stats, trends, scores)
    alerts = serving.acknowledged(raised, q._acks(raised))
    live = q.tables.resolve(scores.withColumn("_at", F.col("window_start")), ["patient_id"], ["_at"])
    ledger = q.tables.ledger_state(q._ledger(s, d))
    days = scores.select(F.to_date("window_start").alias("report_date"))
    found = serving.ward_summary(fx.roster(s, d), live, alerts, ledger, days, F.expr(q.NOW), F.expr("timestamp'2024-01-25 00:00:00'"))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return found.select("patients", text("tiers"), text("active_alerts"), "patients_reporting", "hr_avg", "temp_avg", "lag_minutes", "deteriorating", F.col("latest_lab_file.file_day").cast("string").alias("newest_file"), F.col("latest_report_date").cast("string").alias("latest_report_date"))
