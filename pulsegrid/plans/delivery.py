"""Queries of messages, deliveries, daily features, serving history and progress; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.functions import validation as val
from pulsegrid.operators import delivery, monitors, report, tables, windows
from pulsegrid.plans import queries as q
from pulsegrid.plans.queries import DAY, FMT, at, query
from pulsegrid.sources import fixtures as fx
from pulsegrid.streaming import progress


# Messages -------------------------------------------------------------------------------------------------------------
@query("with " + q.PARSED_SQL + " select origin, value as raw_payload, coalesce(json_type(v) = 'OBJECT', false) as is_object from js")
def envelope_parse(s, d):
    kind = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return val.envelope(fx.raw_vitals(s, d)).select("origin", "raw_payload", kind.alias("is_object"))


@query("with " + q.PARSED_SQL + """ select origin, case json_type(v, '$.heart_rate') when 'VARCHAR' then 'string' when 'DOUBLE' then 'number' when 'UBIGINT' then 'number' when 'BIGINT' then 'number' else 'missing' end as heart_rate,
  case json_type(v, '$.temperature') when 'DOUBLE' then 'number' else 'missing' end as temperature from js""")
def variant_types(s, d):
    def kind(field):
        t = F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
        return F.when(t == "STRING", "string").when(t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("missing").alias(field)

    return val.envelope(fx.raw_vitals(s, d)).select("origin", kind("heart_rate"), kind("temperature"))


@query("with " + q.PARSED_SQL + """ select 'vitals' as key, to_json({'source': 'vitals', 'origin': origin, 'error_reasons': codes, 'raw_payload': value, 'detected_by': 'stream'})::varchar as value
  from coded where len(codes) > 0""")
def deadletter_messages(s, d):
    return val.dead_letters(q._parsed(s, d).where("size(error_reasons) > 0"), "vitals")


@query("with " + q.PARSED_SQL + """, sent as (select *, split_part(origin, ':', 3)::bigint % 10000000 as o from coded where len(codes) > 0)
  select 'vitals' as source, 'vitals.raw:' || o as origin, arg_min(array_to_string(codes, ','), origin) as reasons from sent group by o""")
def deadletter_table(s, d):
    bad = q._parsed(s, d).where("size(error_reasons) > 0")
    # a message that came twice is one origin here; the copy with the lesser offset came first
    same = F.concat(F.lit("vitals.raw:"), F.element_at(F.split("origin", ":"), 3).cast("long") % 10_000_000)
    letters = bad.select(F.lit("vitals").alias("source"), same.alias("origin"), F.array_join("error_reasons", ",").alias("reasons"), F.col("origin").alias("came"))
    return delivery.dead_letter_table(letters, "came").select("source", "origin", "reasons")


def _lab_rows(s, d):
    name = F.concat(F.lit("labs_"), F.col("file_day").cast("string"), F.lit(".csv"))
    return q._coded_labs(s, d).withColumn("source_file", name)


_MESSAGE_SQL = q.LAB_CODED_SQL + ", full_rows as (select *, 'labs_' || file_day || '.csv' as source_file from coded)"


@query("with " + _MESSAGE_SQL + """ select patient_id as key, to_json({'sample_id': sample_id, 'patient_id': patient_id, 'test_type': test_type, 'result_value': value, 'unit': unit, 'reference_range': reference_range,
  'collected_at': collected_at, 'schema_version': 1, 'source_file': source_file, 'file_day': file_day::varchar, 'row_number': row_number})::varchar as value from full_rows where len(codes) = 0""")
def lab_events(s, d):
    return delivery.lab_events(_lab_rows(s, d))


@query("with " + _MESSAGE_SQL + """ select 'labs' as source, source_file || ':' || row_number as origin, array_to_string(codes, ',') as reasons,
  to_json({'sample_id': sample_id, 'patient_id': patient_id, 'test_type': test_type, 'result_value': result_value, 'unit': unit, 'reference_range': reference_range, 'collected_at': collected_at})::varchar as raw_payload
  from full_rows where len(codes) > 0""")
def lab_csv_rejects(s, d):
    return delivery.rejected_rows(_lab_rows(s, d)).select("source", "origin", F.array_join("error_reasons", ",").alias("reasons"), "raw_payload")


# Deliveries and ledgers -----------------------------------------------------------------------------------------------
def _deliveries(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    content = F.sha2(F.concat_ws("|", F.to_date("ts"), F.col("user_id") % 4), 256)
    decision = F.when(F.col("user_id") % 4 == 3, "quarantined").otherwise("loaded")
    return delivery.deliveries(e.select(F.to_date("ts").alias("file_day"), F.col("event_id").alias("seq"), content.alias("checksum"), decision.alias("decision")))


_DELIVERY_SQL = """d0 as (select ts::date as file_day, event_id as seq, sha256(ts::date || '|' || user_id % 4) as checksum, case when user_id % 4 = 3 then 'quarantined' else 'loaded' end as decision from events),
d1 as (select *, last_value(case when decision = 'loaded' then checksum end ignore nulls) over (partition by file_day order by seq rows between unbounded preceding and 1 preceding) as before from d0),
d2 as (select *, case when before = checksum then 'duplicate' when decision <> 'loaded' and before is not null then 'quarantined_file_only' else decision end as outcome from d1)"""


@query("with " + _DELIVERY_SQL + " select seq, file_day::varchar as file_day, outcome = 'duplicate' as duplicate from d2")
def lab_duplicate_delivery(s, d):
    return _deliveries(s, d).select("seq", F.col("file_day").cast("string").alias("file_day"), (F.col("outcome") == "duplicate").alias("duplicate"))


@query("with " + _DELIVERY_SQL + " select file_day::varchar as file_day, outcome, count(*) as n from d2 group by 1, 2")
def lab_redelivery_guard(s, d):
    return _deliveries(s, d).groupBy(F.col("file_day").cast("string").alias("file_day"), "outcome").agg(F.count("*").alias("n"))


_LEDGER_SQL = q.ORACLES["ledger_state"]


@query(f"with led as ({_LEDGER_SQL}), " + fx.LABS_SQL + """, have as (select file_day::varchar as file_day, count(*) as stored from (select distinct sample_id, test_type, file_day from labs) group by 1)
  select file_day, coalesce(stored, 0)::bigint as stored, status <> 'loaded' or coalesce(stored, 0) >= rows_valid as ready from led left join have using (file_day)""")
def labs_ready(s, d):
    stored = fx.labs(s, d).select("sample_id", "test_type", "file_day").distinct()
    return delivery.labs_ready(tables.ledger_state(q._ledger(s, d)), stored).withColumn("file_day", F.col("file_day").cast("string"))


@query(f"with led as ({_LEDGER_SQL}) select status, count(*) as n from led group by 1")
def ledger_status_counts(s, d):
    return tables.ledger_state(q._ledger(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with led as ({_LEDGER_SQL}) select file_day, status, rows_valid from led where led.file_day::date > (select max(file_day::date) from led) - 3")
def recent_ledger(s, d):
    ledger = tables.ledger_state(q._ledger(s, d))
    newest = ledger.agg(F.max("file_day").alias("_newest"))  # one row
    near = ledger.join(F.broadcast(newest), F.col("file_day") > F.date_sub("_newest", 3))
    return near.select(F.col("file_day").cast("string").alias("file_day"), "status", "rows_valid")


@query("with " + q._RUNS_SQL + " select dag_id, task_id, state, count(*) as n from runs group by all")
def task_run_counts(s, d):
    return q._runs(s, d).groupBy("dag_id", "task_id", "state").agg(F.count("*").alias("n"))


# Daily features and the report's file ---------------------------------------------------------------------------------
def _day():
    return F.to_date("window_start")


@query("with " + q.SCORES_SQL + "," + q.HOURLY_SQL + "," + q.VITALS_DAY_SQL + " select * exclude (report_date, " + ", ".join(f"{v}_tail" for v in rules.BANDS) + "), report_date::varchar as report_date, " + ", ".join(f"round({v}_tail, 5) as {v}_tail" for v in rules.BANDS) + " from dv")
def daily_vitals(s, d):
    days = report.daily_vitals(q._built(s, d, "1 hour")[2], _day())
    return days.withColumns({"report_date": F.col("report_date").cast("string")} | {f"{v}_tail": F.round(f"{v}_tail", 5) for v in rules.BANDS})


@query("with " + fx.READINGS_SQL + "," + q.TRENDS_SQL + """ select (we - interval '1 day')::date::varchar as report_date, patient_id, count(*) filter (where trend = 'deteriorating') as deteriorating_windows,
  round(max(worse), 4) as max_index, coalesce(max_by(trend, we) filter (where trend <> 'insufficient_data'), 'unknown') as last_trend from trends group by 1, 2""")
def daily_trends(s, d):
    days = report.daily_trends(q._trends(s, d), F.to_date(F.col("window_end") - F.expr("interval 1 day")))
    return days.withColumns({"report_date": F.col("report_date").cast("string"), "max_index": F.round("max_index", 4)})


_severities = ", ".join(f"count(*) filter (where severity = '{x}') as alerts_{x}" for x in ("critical", "high", "medium"))


@query("with " + q.ALERTS_SQL + f" select ws::date::varchar as report_date, patient_id, {_severities} from alerts group by 1, 2")
def daily_alerts(s, d):
    return report.daily_alerts(q._alerts(s, d), _day()).withColumn("report_date", F.col("report_date").cast("string"))


@query("with " + q.ALERTS_SQL + f" select patient_id, alert_type, strftime(ws, {FMT}) as window_start, alert_id from alerts")
def alert_ids(s, d):
    return q._alerts(s, d).select("patient_id", "alert_type", at("window_start").alias("window_start"), "alert_id")


@query("with " + q.STATS_SQL + "," + fx.LABS_SQL + "," + q.ADJUST_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, test_type, result_value from latest48")
def labs_48h_latest(s, d):
    labs = _window_labs(s, d).select("patient_id", "window_start", F.explode("labs").alias("l"))
    return labs.select("patient_id", at("window_start").alias("window_start"), "l.test_type", F.col("l.value").alias("result_value"))


def _window_labs(s, d):
    ends = q._stats(s, d).select("patient_id", "window_start", "window_end")
    return delivery.latest_results(windows.range_join(ends, q._labs(s, d), "collected_at", F.expr("interval 48 hours"), 2 * DAY))


_range = "case test_type " + " ".join(f"when '{t}' then '{r}'" for t, r in zip(fx.TESTS, fx.RANGE_TEXTS)) + " end"
_TEXTS_SQL = f"""
bounded as (select *, {_range} as rr from latest48),
flagged as (select *, case when result_value < (case when rr like '<%' then 0 else split_part(rr, '-', 1)::double end) then '(L)'
  when result_value > (case when rr like '<%' then substr(rr, 2)::double else split_part(rr, '-', 2)::double end) then '(H)' else '' end as mark from bounded),
texts as (select patient_id, ws, string_agg(test_type || '=' || format('{{:g}}', result_value) || mark, '; ' order by test_type) as labs_latest, count(*) as n from flagged group by 1, 2)"""


@query("with " + q.STATS_SQL + "," + fx.LABS_SQL + "," + q.ADJUST_SQL + "," + _TEXTS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, n as tests, labs_latest from texts")
def labs_map(s, d):
    return _window_labs(s, d).select("patient_id", at("window_start").alias("window_start"), F.size("labs").cast("long").alias("tests"), delivery.labs_text(delivery.labs_map(F.col("labs"))).alias("labs_latest"))


@query("with " + q.REPORT_SQL + "," + _TEXTS_SQL.replace("latest48", "dlab").replace("patient_id, ws,", "patient_id, report_date,") + """ select report.* exclude (tests), coalesce(t.labs_latest, '') as labs_latest
  from report left join texts t on t.patient_id = report.patient_id and t.report_date::varchar = report.report_date""")
def report_csv_rows(s, d):
    cells = delivery.report_csv(q._report(s, d))
    return cells.withColumns({"report_date": F.col("report_date").cast("string"), "max_index": F.round("max_index", 4)})


# Serving --------------------------------------------------------------------------------------------------------------
@query("with " + q.SCORES_SQL + "," + fx.ROSTER_SQL + """, live as (select patient_id, max_by({'s': total_score, 't': risk_tier}, ws) as r from scores group by 1)
  select patient_id, bed, active, r.s as total_score, r.t as risk_tier from roster left join live using (patient_id)""")
def patient_status(s, d):
    live = tables.resolve(q._scores(s, d).select("patient_id", "total_score", "risk_tier", "window_start"), ["patient_id"], ["window_start"])
    return fx.roster(s, d).select("patient_id", "bed", "active").join(live, "patient_id", "left").drop("window_start")


@query("with " + fx.READINGS_SQL + "," + q.TRENDS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, trend, round(worse, 4) as deterioration_index from trends where we > timestamp '2024-01-20' order by patient_id, ws")
def patient_trend_history(s, d):
    recent = q._trends(s, d).where("window_end > timestamp'2024-01-20 00:00:00'").orderBy("patient_id", "window_start")
    return recent.select("patient_id", at("window_start").alias("window_start"), "trend", F.round("deterioration_index", 4).alias("deterioration_index"))


# Progress and monitors ------------------------------------------------------------------------------------------------
def _progress(s, d):
    """Each event as a batch's progress: two partitions, of which the first is behind by the user's number."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    text = lambda a, b: F.concat(F.lit('{"vitals.raw":{"0":'), a.cast("string"), F.lit(',"1":'), b.cast("string"), F.lit("}}"))
    n, behind = F.col("event_id"), F.col("user_id")
    source = F.struct(text(n + behind, n).alias("latest"), text(n, n + 5).alias("end"))
    return e.select(F.col("event_type").alias("name"), n.alias("batch_id"), "at", (n % 50 + 50).alias("input_rows"), (n % 4).alias("dropped"), F.array(source).alias("sources"))


@query("select event_type as name, event_id as batch_id, user_id::bigint as lag from events")
def source_lag(s, d):
    return progress.source_lag(_progress(s, d)).select("name", "batch_id", "lag")


@query("""select event_type as name, sum(event_id % 50 + 50)::bigint as rows, sum(event_id % 4)::bigint as dropped, round(sum(event_id % 4)::double / sum(event_id % 50 + 50)::double, 6) as share from events group by 1""")
def progress_late_share(s, d):
    return progress.late_share(_progress(s, d)).withColumn("share", F.round("share", 6))


@query("""with c as (select event_type as name, date_trunc('hour', ts) as h, max(user_id) as lag from events group by 1, 2),
st as (select name, floor(epoch(h))::bigint as t, lag > 10 as firing from c),
isl as (select *, row_number() over (partition by name order by t) - row_number() over (partition by name, firing order by t) as i from st)
select name, min(t) as since, max(t) as until from isl where firing group by name, i having max(t) - min(t) >= 7200""")
def monitor_lag(s, d):
    hourly = progress.source_lag(_progress(s, d)).groupBy("name", F.unix_timestamp(F.date_trunc("hour", "at")).alias("t")).agg(F.max("lag").alias("lag"))
    return monitors.sustained(hourly.select("name", "t", (F.col("lag") > 10).alias("firing")), "name", "t", "firing", 7200)


@query("with " + fx.READINGS_SQL + """, c as (select patient_id, floor(epoch(event_time))::bigint as t, count(*) as n, count(*) filter (where epoch_us(produced_at) - epoch_us(event_time) > 80000000) as m from readings group by 1, 2),
sh as (select patient_id, t, (sum(m) over w)::double / (sum(n) over w)::double as share from c window w as (partition by patient_id order by t range between 86400 preceding and current row))
select patient_id, t, round(share, 6) as share, share > 0.03 as firing from sh""")
def monitor_late_share(s, d):
    late = F.unix_micros("produced_at") - F.unix_micros("event_time") > 80_000_000
    return monitors.trailing_share(fx.readings(s, d), "patient_id", "event_time", late, DAY, 0.03).withColumn("share", F.round("share", 6))


@query("""with c as (select event_type as source, floor(epoch(ts))::bigint as t, count(*) filter (where event_id % 3 = 0) as m from events group by 1, 2)
select source, t, n, n > 2 as firing from (select source, t, (sum(m) over (partition by source order by t range between 600 preceding and current row))::bigint as n from c)""")
def monitor_ledger_delta(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("source"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    return monitors.trailing_count(e, "source", "at", F.col("event_id") % 3 == 0, 600, 2)
