"""The queries of the library over tables derived from the given ones, with SQL for each that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.functions import validation as val
from pulsegrid.operators import delivery, monitors, report, serving, tables, windows
from pulsegrid.sources import fixtures as fx

DAY = 86400
NOW = "timestamp'2024-01-31 00:00:00'"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _stats(s, d):
    return windows.tumbling_stats(fx.readings(s, d), "1 day")


def _trends(s, d):
    return windows.with_trend(windows.sliding_slopes(fx.readings(s, d), "4 days", "1 day", DAY), 20)


def _labs(s, d):
    """The results that look-backs of whole hours can need."""
    return windows.newest_by_grain(fx.labs(s, d).select("patient_id", "test_type", "collected_at", "sample_id", "result_value", "reference_range", "unit"))


def _built(s, d, length="1 day", trends=None, labs=None):
    """Statistics, trends and scores, each computed once; ``trends`` and ``labs`` that are there already serve other windows too."""
    labs = _labs(s, d) if labs is None else labs
    stats = tables.materialised(windows.tumbling_stats(fx.readings(s, d), length))
    trends = tables.materialised(_trends(s, d)) if trends is None else trends
    return stats, trends, tables.materialised(windows.window_scores(stats, windows.lab_adjustments(stats, labs), windows.latest_trend(stats, trends, 48)))


def _scores(s, d):
    return _built(s, d)[2]


def _raised(stats, trends, scores):
    return windows.threshold_alerts(stats).unionByName(windows.risk_alerts(scores)).unionByName(windows.trend_alerts(trends))


def _alerts(s, d):
    return _raised(*_built(s, d))


def _known(s, d):
    """The ids of the roster. It has at most 20 rows, but is told from all events: by their size messages would be shuffled to 20 keys."""
    return F.broadcast(fx.roster(s, d).select("patient_id"))


def _parsed(s, d):
    return val.parse_vitals(fx.raw_vitals(s, d), _known(s, d))


# SQL building blocks -------------------------------------------------------------------------------------------------
FMT = "'%Y-%m-%d %H:%M:%S'"


def _points_sql(vital, x):
    bands = rules.BANDS[vital]
    return f"(case when {x} is null then 0 " + " ".join(f"when {x} <= {top} then {p}" for top, p in bands[:-1]) + f" else {bands[-1][1]} end)"


def _score_sql(suffix):
    each = [_points_sql(v, f"{v}{suffix}") for v in rules.BANDS]
    return " + ".join(each), f"greatest({', '.join(each)}) >= 3"


def _index_sql(sign):
    return " + ".join(f"greatest(coalesce({v}_slope, 0) * {float(sign * d)}::double / {float(scale)}::double, 0)" for v, (d, scale) in rules.TREND_SIGNALS.items())


def _tier_sql(score, red):
    return f"case when {score} >= 7 then 'HIGH' when {score} >= 5 or {red} then 'MEDIUM' else 'LOW' end"


_breach = {a: f"{v} {how} {limit}" for a, (v, how, limit, *_) in rules.THRESHOLDS.items()}
STATS_SQL = fx.READINGS_SQL + """,
stats as (
  select patient_id, time_bucket(interval '1 day', event_time, timestamp '1970-01-01') as ws, count(*) as n_readings, """ + ", ".join(
    f"{f}({v}) as {v}_{n}" for v in rules.VITALS for n, f in (("avg", "avg"), ("min", "min"), ("max", "max"))) + ", " + ", ".join(
    f"count(*) filter (where {c}) as breach_{a}" for a, c in _breach.items()) + """
  from readings group by 1, 2)"""
_s, _r = _score_sql("_avg")
EWS_SQL = STATS_SQL + f""",
ews as (select *, {_s} as ews_score, {_r} as ews_red from stats)"""
TRENDS_SQL = """
slid as (select r.*, time_bucket(interval '1 day', event_time, timestamp '1970-01-01') - to_days(o.o) as ws from readings r, (select unnest([0, 1, 2, 3])::int as o) o),
slopes as (
  select patient_id, ws, count(*) as n_readings, """ + ", ".join(f"case when min(event_time) < max(event_time) then regr_slope({v}, epoch_us(event_time)::double / 86400000000.0::double) end as {v}_slope" for v in rules.TREND_SIGNALS) + f"""
  from slid group by 1, 2),
indexed as (select *, {_index_sql(1)} as worse, {_index_sql(-1)} as better from slopes),
trends as (
  select *, ws + interval '4 days' as we, case when n_readings < 20 then 'insufficient_data' when worse >= 5 and worse > better then 'deteriorating'
    when better >= 5 and better > worse then 'improving' else 'stable' end as trend from indexed)"""
_rule = "case " + " ".join(f"when test_type = '{t}' and result_value {h} {l} then {{}}" for t, h, l, p, f in rules.LAB_RULES) + " end"
_pts = _rule.format(*[p for *_, p, f in rules.LAB_RULES])
_flg = _rule.format(*[f"'{f}'" for *_, p, f in rules.LAB_RULES])
ADJUST_SQL = f"""
within48 as (select s.patient_id, s.ws, l.test_type, l.result_value, l.collected_at, l.sample_id from stats s join labs l on s.patient_id = l.patient_id
  and l.collected_at > s.ws + interval '1 day' - interval '48 hours' and l.collected_at <= s.ws + interval '1 day'),
latest48 as (select patient_id, ws, test_type, max_by(result_value, (collected_at, sample_id, result_value)) as result_value from within48 group by 1, 2, 3),
met as (select patient_id, ws, {_pts} as pts, {_flg} as flag from latest48),
adjust as (select patient_id, ws, least(coalesce(sum(pts), 0), 4)::int as lab_adjustment, coalesce(list_sort(list(flag) filter (where flag is not null)), []) as flags from met group by 1, 2)"""
SCORES_SQL = EWS_SQL + "," + TRENDS_SQL + "," + fx.LABS_SQL + "," + ADJUST_SQL + f""",
recent as (select s.patient_id, s.ws, max_by(t.trend, t.we) as trend from stats s join trends t on s.patient_id = t.patient_id and t.trend <> 'insufficient_data'
  and t.we > s.ws + interval '1 day' - interval '48 hours' and t.we <= s.ws + interval '1 day' group by 1, 2),
composed as (
  select e.*, coalesce(a.lab_adjustment, 0) as lab_adjustment, coalesce(a.flags, []) as flags, coalesce(t.trend, 'unknown') as trend,
    (e.ews_score + coalesce(a.lab_adjustment, 0) + case when t.trend = 'deteriorating' then 1 else 0 end)::int as total_score
  from ews e left join adjust a using (patient_id, ws) left join recent t using (patient_id, ws)),
scores as (select *, {_tier_sql('total_score', 'ews_red')} as risk_tier from composed)"""
_id = "substr(sha256(patient_id || '|' || alert_type || '|' || strftime(ws, " + FMT + ")), 1, 32)"
ALERTS_SQL = SCORES_SQL + """,
raised as (""" + " union all ".join(
    f"select patient_id, ws, ws + interval '1 day' as we, '{a}' as alert_type, '{sev}' as severity, {v}_{'max' if how == '>' else 'min'}::double as observed_value, {float(limit)}::double as threshold, printf('{v} {how} {limit}: worst %.1f, %d readings in window', {v}_{'max' if how == '>' else 'min'}::double, breach_{a}) as message from stats where breach_{a} >= {least}"
    for a, (v, how, limit, least, sev) in rules.THRESHOLDS.items()) + """
  union all select patient_id, ws, ws + interval '1 day', 'RISK_HIGH', 'critical', total_score::double, 7.0::double, printf('risk score %d (EWS %d + labs %d + trend %d)', total_score, ews_score::int, lab_adjustment, case when trend = 'deteriorating' then 1 else 0 end) from scores where risk_tier = 'HIGH'
  union all select patient_id, ws, we, 'TREND_DETERIORATING', 'medium', worse, 5.0::double, printf('sustained deterioration over 4 h (index %.1f; HR %+.1f/h, SpO2 %+.2f/h, SBP %+.1f/h, T %+.2f/h)', worse, heart_rate_slope, spo2_slope, systolic_bp_slope, temperature_slope) from trends where trend = 'deteriorating'),
alerts as (select *, """ + _id + " as alert_id from raised)"


# Windows and scores ---------------------------------------------------------------------------------------------------
@query("with " + STATS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, n_readings, " + ", ".join(f"round({v}_avg, 6) as {v}_avg, {v}_min, {v}_max" for v in rules.VITALS) + " from stats")
def tumbling_stats(s, d):
    return _stats(s, d).select("patient_id", at("window_start").alias("window_start"), "n_readings", *[c for v in rules.VITALS for c in (F.round(f"{v}_avg", 6).alias(f"{v}_avg"), f"{v}_min", f"{v}_max")])


@query("with " + STATS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, " + ", ".join(f"breach_{a}" for a in rules.THRESHOLDS) + " from stats")
def breach_counts(s, d):
    return _stats(s, d).select("patient_id", at("window_start").alias("window_start"), *[f"breach_{a}" for a in rules.THRESHOLDS])


@query("with " + fx.READINGS_SQL + " select event_id, " + ", ".join(f"{_points_sql(v, v)}::int as {v}_points" for v in rules.BANDS) + " from readings")
def ews_points(s, d):
    return fx.readings(s, d).select("event_id", *[rules.points(v, F.col(v)).alias(f"{v}_points") for v in rules.BANDS])


@query("with " + EWS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, ews_score::int as ews_score, ews_red as ews_red_flag, {_tier_sql('ews_score', 'ews_red')} as tier from ews")
def ews_score(s, d):
    w = windows.with_early_warning(_stats(s, d))
    return w.select("patient_id", at("window_start").alias("window_start"), "ews_score", "ews_red_flag", rules.tier(F.col("ews_score"), F.col("ews_red_flag")).alias("tier"))


@query("with " + fx.READINGS_SQL + "," + TRENDS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, n_readings, " + ", ".join(f"round({v}_slope, 5) as {v}_slope" for v in rules.TREND_SIGNALS) + " from trends")
def sliding_slopes(s, d):
    return _trends(s, d).select("patient_id", at("window_start").alias("window_start"), "n_readings", *[F.round(f"{v}_slope", 5).alias(f"{v}_slope") for v in rules.TREND_SIGNALS])


@query("with " + fx.READINGS_SQL + "," + TRENDS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, round(worse, 4) as deterioration_index, round(better, 4) as improvement_index, trend from trends")
def trend_class(s, d):
    return _trends(s, d).select("patient_id", at("window_start").alias("window_start"), F.round("deterioration_index", 4).alias("deterioration_index"), F.round("improvement_index", 4).alias("improvement_index"), "trend")


@query("with " + STATS_SQL + "," + fx.LABS_SQL + "," + ADJUST_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, lab_adjustment, array_to_string(flags, ',') as flags from adjust")
def lab_adjustment(s, d):
    return windows.lab_adjustments(_stats(s, d), fx.labs(s, d)).select("patient_id", at("window_start").alias("window_start"), "lab_adjustment", F.array_join("lab_flags", ",").alias("flags"))


@query("with " + STATS_SQL + "," + fx.LABS_SQL + "," + ADJUST_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, count(*) as n_labs, round(sum(result_value), 3) as total from within48 group by 1, 2")
def lab_window_join(s, d):
    j = windows.range_join(_stats(s, d).select("patient_id", "window_start", "window_end"), fx.labs(s, d), "collected_at", F.expr("interval 48 hours"), 48 * 3600)
    return j.groupBy("patient_id", at("window_start").alias("window_start")).agg(F.count("*").alias("n_labs"), F.round(F.sum("result_value"), 3).alias("total"))


@query("with " + SCORES_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, trend from recent")
def asof_trend(s, d):
    return windows.latest_trend(_stats(s, d), _trends(s, d), 48).select("patient_id", at("window_start").alias("window_start"), "trend")


@query("with " + SCORES_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, ews_score::int as ews_score, lab_adjustment, array_to_string(flags, ',') as flags, trend, total_score, risk_tier from scores")
def window_scores(s, d):
    return _scores(s, d).select("patient_id", at("window_start").alias("window_start"), "ews_score", "lab_adjustment", F.array_join("lab_flags", ",").alias("flags"), "trend", "total_score", "risk_tier")


_ALERT_SELECT = f" select alert_id, patient_id, strftime(ws, {FMT}) as window_start, alert_type, severity, round(observed_value, 4) as observed_value, threshold, message from alerts"


def _alert_columns(df):
    return df.select("alert_id", "patient_id", at("window_start").alias("window_start"), "alert_type", "severity", F.round("observed_value", 4).alias("observed_value"), "threshold", "message")


@query("with " + ALERTS_SQL + _ALERT_SELECT + " where alert_type not in ('RISK_HIGH', 'TREND_DETERIORATING')")
def threshold_alerts(s, d):
    return _alert_columns(windows.threshold_alerts(_stats(s, d)))


@query("with " + ALERTS_SQL + _ALERT_SELECT + " where alert_type = 'RISK_HIGH'")
def risk_alerts(s, d):
    return _alert_columns(windows.risk_alerts(_scores(s, d)))


@query("with " + ALERTS_SQL + _ALERT_SELECT + " where alert_type = 'TREND_DETERIORATING'")
def trend_alerts(s, d):
    return _alert_columns(windows.trend_alerts(_trends(s, d)))


@query("with " + ALERTS_SQL + " select severity, alert_type, count(*) as alerts, count(distinct alert_id) as ids from alerts group by 1, 2")
def active_alerts_by_severity(s, d):
    return _alerts(s, d).groupBy("severity", "alert_type").agg(F.count("*").alias("alerts"), F.countDistinct("alert_id").alias("ids"))


@query("with " + ALERTS_SQL + """ select alert_id, patient_id, alert_type, severity from alerts
  order by case severity when 'critical' then 0 when 'high' then 1 else 2 end, we desc, alert_id limit 50""")
def active_alerts(s, d):
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    return _alerts(s, d).orderBy(rank, F.desc("window_end"), "alert_id").limit(50).select("alert_id", "patient_id", "alert_type", "severity")


@query("with " + ALERTS_SQL + """ select alert_id, patient_id, alert_type, severity from alerts where patient_id = 'P001' and severity in ('critical', 'high') and ws >= timestamp '2024-01-10'""")
def filtered_alerts(s, d):
    return serving.filtered(_alerts(s, d), patient_id="P001", severities=["critical", "high"], since=F.expr("timestamp'2024-01-10 00:00:00'")).select("alert_id", "patient_id", "alert_type", "severity")


@query("with " + ALERTS_SQL + " select alert_id from alerts where ws >= timestamp '2024-01-16'")
def new_alerts_antijoin(s, d):
    a = _alerts(s, d)
    return tables.new_rows(a.select("alert_id", "window_start"), a.where("window_start < timestamp'2024-01-16 00:00:00'"), "alert_id").select("alert_id")


@query("with " + SCORES_SQL + f" select patient_id, strftime(max(ws), {FMT}) as window_start, max_by(total_score, ws) as total_score, max_by(risk_tier, ws) as risk_tier from scores group by 1")
def live_status(s, d):
    log = _scores(s, d).select("patient_id", "window_start", "total_score", "risk_tier")
    return tables.resolve(log, ["patient_id"], ["window_start"]).select("patient_id", at("window_start").alias("window_start"), "total_score", "risk_tier")


_LIVE = SCORES_SQL + "," + fx.ROSTER_SQL + ", live as (select patient_id, max_by(total_score, ws) as total_score, max_by(risk_tier, ws) as risk_tier from scores group by 1)"


@query("with " + _LIVE + " select coalesce(risk_tier, 'NO_DATA') as risk_tier, count(*) as patients from roster left join live using (patient_id) where active group by 1")
def ward_tiers(s, d):
    return fx.roster(s, d).where("active").join(live_status(s, d), "patient_id", "left").groupBy(F.coalesce("risk_tier", F.lit("NO_DATA")).alias("risk_tier")).agg(F.count("*").alias("patients"))


@query("with " + _LIVE + " select patient_id, bed, total_score, risk_tier from roster left join live using (patient_id) where active order by total_score desc nulls last, patient_id")
def patients_by_risk(s, d):
    return fx.roster(s, d).where("active").join(live_status(s, d), "patient_id", "left").orderBy(F.desc_nulls_last("total_score"), "patient_id").select("patient_id", "bed", "total_score", "risk_tier")


@query("with " + EWS_SQL + f" select patient_id, strftime(ws, {FMT}) as window_start, round(heart_rate_avg, 1) as hr, round(spo2_avg, 1) as spo2 from ews where ws >= timestamp '2024-01-10' order by patient_id, ws")
def patient_vitals_history(s, d):
    return _stats(s, d).where("window_start >= timestamp'2024-01-10 00:00:00'").orderBy("patient_id", "window_start").select("patient_id", at("window_start").alias("window_start"), F.round("heart_rate_avg", 1).alias("hr"), F.round("spo2_avg", 1).alias("spo2"))


# Validation -----------------------------------------------------------------------------------------------------------
def _code(name, prefix):
    def run(s, d):
        return _parsed(s, d).select("origin", F.explode("error_reasons").alias("code")).where(F.col("code").startswith(prefix))

    QUERIES[name] = run


_J = "json_extract_string(v, '$.{}')"
PARSED_SQL = fx.RAW_VITALS_SQL + "," + fx.ROSTER_SQL + """,
js as (select 'vitals.raw:' || part || ':' || ofs as origin, value, json_valid(value) as ok, case when json_valid(value) then value end as v from raw_vitals),
coded as (
  select origin, value, v, case when not ok then ['invalid_json'] else list_filter([""" + ", ".join(
    [f"case when json_extract(v, '$.{f}') is null then 'missing:{f}' end" for f in val.VITALS_FIELDS]
    + ["case when not regexp_full_match(json_extract_string(v, '$.patient_id'), 'P[0-9]{3}') then 'bad_patient_id' end"]
    + [x for f in rules.VITALS for x in (f"case when json_type(v, '$.{f}') = 'VARCHAR' then 'type:{f}' end", f"case when json_type(v, '$.{f}') <> 'VARCHAR' and not try_cast(json_extract_string(v, '$.{f}') as double) between {rules.RANGES[f][0]} and {rules.RANGES[f][1]} then 'range:{f}' end")]
    + ["case when try_cast(json_extract_string(v, '$.diastolic_bp') as double) >= try_cast(json_extract_string(v, '$.systolic_bp') as double) then 'bp_inverted' end"]
    + [f"case when not regexp_full_match(json_extract_string(v, '$.{f}'), '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z') then 'bad_timestamp:{f}' end" for f in ("timestamp", "produced_at")]
    + ["case when regexp_full_match(json_extract_string(v, '$.patient_id'), 'P[0-9]{3}') and json_extract_string(v, '$.patient_id') not in (select patient_id from roster) then 'unknown_patient' end"]
) + """], lambda x: x is not null) end as codes from js)"""
for _name, _prefix in {"err_missing": "missing:", "err_type": "type:", "err_range": "range:", "err_bp_inverted": "bp_inverted", "err_patient_id": "bad_patient_id", "err_timestamp": "bad_timestamp", "err_unknown_patient": "unknown_patient", "err_object_guard": "invalid_json"}.items():
    _code(_name, _prefix)
    ORACLES[_name] = "with " + PARSED_SQL + f" select * from (select origin, unnest(codes) as code from coded) where starts_with(code, '{_prefix}')"


@query("with " + PARSED_SQL + f""" select origin, {_J.format('event_id')} as event_id, {_J.format('patient_id')} as patient_id,
  case when json_type(v, '$.heart_rate') <> 'VARCHAR' then try_cast({_J.format('heart_rate')} as double) end as heart_rate, array_to_string(codes, ',') as errors from coded""")
def parse_vitals(s, d):
    return _parsed(s, d).select("origin", "event_id", "patient_id", F.col("heart_rate"), F.array_join("error_reasons", ",").alias("errors"))


@query("with " + PARSED_SQL + f" select {_J.format('event_id')} as event_id, {_J.format('patient_id')} as patient_id, try_cast({_J.format('temperature')} as double) as temperature from coded where len(codes) = 0")
def valid_vitals(s, d):
    return val.valid_vitals(_parsed(s, d)).select("event_id", "patient_id", "temperature")


@query("with " + PARSED_SQL + f" select count(distinct {_J.format('event_id')}) as events, count(*) as messages from coded where len(codes) = 0")
def vitals_dedup(s, d):
    good = val.valid_vitals(_parsed(s, d))
    return good.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("events"), F.sum("n").alias("messages"))


@query("with " + PARSED_SQL + " select case when len(codes) = 0 then 'valid' else codes[1] end as outcome, count(*) as n from coded group by 1")
def quality_counts(s, d):
    return _parsed(s, d).groupBy(F.when(F.size("error_reasons") == 0, "valid").otherwise(F.get("error_reasons", F.lit(0))).alias("outcome")).agg(F.count("*").alias("n"))


@query("with " + PARSED_SQL + " select codes[1] as reason, count(*) as n from coded where len(codes) > 0 group by 1 order by n desc, reason limit 8")
def deadletter_reasons(s, d):
    return _parsed(s, d).where("size(error_reasons) > 0").groupBy(F.get("error_reasons", F.lit(0)).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query("with " + PARSED_SQL + " select 'vitals' as source, origin, array_to_string(codes, ',') as reasons, value as raw_payload, 'stream' as detected_by from coded where len(codes) > 0")
def deadletter_parse(s, d):
    sent = val.dead_letters(_parsed(s, d).where("size(error_reasons) > 0"), "vitals")
    return val.parse_dead_letters(sent).select("source", "origin", F.array_join("error_reasons", ",").alias("reasons"), "raw_payload", "detected_by")


# Labs -------------------------------------------------------------------------------------------------------------
LAB_FAULTS = 13
LAB_RAW_SQL = fx.LABS_SQL + "," + fx.ROSTER_SQL + f""",
faulted as (select *, split_part(sample_id, '-', 2)::int as row_number, case when split_part(sample_id, '-', 1)::bigint % 33 = 0 then (split_part(sample_id, '-', 1)::bigint // 33 + split_part(sample_id, '-', 2)::bigint) % {LAB_FAULTS} end as fault from labs),
raw_labs as (
  select sample_id, row_number, case when fault = 0 then '' when fault = 1 then 'X9' when fault = 10 then 'P950' else patient_id end as patient_id, case when fault = 4 then 'GLU' else test_type end as test_type,
    case when fault = 2 then 'haemolysed' when fault = 3 then '99999999' when fault = 11 then round(result_value, 3) || 'd' when fault = 12 then round(result_value, 3) || 'f' else round(result_value, 3)::varchar end as result_value,
    case when fault = 8 then ' ' else case test_type """ + " ".join(f"when '{t}' then '{u}'" for t, (u, *_) in rules.LAB_CATALOGUE.items()) + """ end end as unit,
    case when fault = 5 then 'normal' else reference_range end as reference_range,
    case when fault = 6 then 'morning' when fault = 9 then strftime(collected_at, '%Y-%m-%dT%H:%M:%S') else strftime(collected_at, '%Y-%m-%dT%H:%M:%SZ') end as collected_at,
    case when fault = 7 then file_day + 1 else file_day end as file_day, case when fault = 8 then null else 1 end as schema_version
  from faulted)"""
_plausible = " or ".join(f"(test_type = '{t}' and value between {lo} and {hi})" for t, (_, lo, hi) in rules.LAB_CATALOGUE.items())
_tests = ", ".join(f"'{t}'" for t in rules.LAB_CATALOGUE)
_ID = "case when patient_id <> '' and not regexp_full_match(patient_id, 'P[0-9]{3}') then 'bad_patient_id' end"
_UNKNOWN = "case when regexp_full_match(patient_id, 'P[0-9]{3}') and patient_id not in (select patient_id from roster) then 'unknown_patient' end"
_CONTENT = f"""case when test_type not in ({_tests}) then 'unknown_test' end, case when value is null then 'non_numeric_result' end,
    case when test_type in ({_tests}) and value is not null and not ({_plausible}) then 'implausible_result' end,
    case when reference_range = 'normal' then 'bad_reference_range' end, case when cat is null then 'bad_collected_at' end,
    case when cat::date <> file_day then 'collected_outside_file_day' end"""
_BLANK = "case when patient_id = '' then 'missing:patient_id' end, case when trim(unit) = '' then 'missing:unit' end"
LAB_CODED_SQL = LAB_RAW_SQL + f""",
cast_labs as (select *, try_cast(result_value as double) as value, case when collected_at like '%Z' then try_cast(rtrim(collected_at, 'Z') as timestamp) end as cat from raw_labs),
coded as (select *, list_filter([{_BLANK}, {_ID}, {_UNKNOWN}, {_CONTENT}], lambda x: x is not null) as codes,
  list_filter([{_BLANK}, case when schema_version is null then 'missing:schema_version' end, {_ID}, {_CONTENT}, {_UNKNOWN}], lambda x: x is not null) as message_codes from cast_labs)"""


def _raw_labs(s, d):
    """Lab cells of which some are faulty, by kind."""
    parts = F.split("sample_id", "-")
    fault = F.when(F.get(parts, F.lit(0)).cast("long") % 33 == 0, ((F.get(parts, F.lit(0)).cast("long") / 33).cast("long") + F.get(parts, F.lit(1)).cast("long")) % LAB_FAULTS)
    l = fx.spread(fx.labs(s, d), "sample_id").withColumns({"fault": fault, "row_number": F.get(parts, F.lit(1)).cast("int")})
    is_ = lambda n: F.col("fault") == n
    unit = F.create_map(*[F.lit(x) for t, (u, *_) in rules.LAB_CATALOGUE.items() for x in (t, u)])
    return l.select(
        "sample_id", "row_number", F.when(is_(0), "").when(is_(1), "X9").when(is_(10), "P950").otherwise(F.col("patient_id")).alias("patient_id"), F.when(is_(4), "GLU").otherwise(F.col("test_type")).alias("test_type"),
        F.when(is_(2), "haemolysed").when(is_(3), "99999999").otherwise(F.concat(F.round("result_value", 3).cast("string"), F.when(is_(11), "d").when(is_(12), "f").otherwise(""))).alias("result_value"), F.when(is_(8), " ").otherwise(unit[F.col("test_type")]).alias("unit"),
        F.when(is_(5), "normal").otherwise(F.col("reference_range")).alias("reference_range"),
        F.when(is_(6), "morning").when(is_(9), F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("collected_at"),
        F.when(is_(7), F.date_add("file_day", 1)).otherwise(F.col("file_day")).alias("file_day"), F.when(is_(8), None).otherwise(1).alias("schema_version"),
    )


def _coded_labs(s, d):
    return val.lab_errors(_raw_labs(s, d), _known(s, d))


def _lab_messages(s, d):
    """The cells as JSON messages; results that are numbers are JSON numbers."""
    cells = _raw_labs(s, d)
    number = val.number(F.col("result_value")).isNotNull()
    result = F.when(number, F.col("result_value")).otherwise(F.concat(F.lit('"'), F.col("result_value"), F.lit('"')))
    rest = F.to_json(F.struct("sample_id", "patient_id", "test_type", "unit", "reference_range", "collected_at", "schema_version", F.concat(F.lit("labs_"), F.col("file_day").cast("string"), F.lit(".csv")).alias("source_file"), F.col("file_day").cast("string").alias("file_day"), "row_number"))
    text = F.concat(F.lit('{"result_value":'), result, F.lit(","), F.substring(rest, 2, 1 << 20))
    return cells.select(F.col("patient_id").cast("binary").alias("key"), text.cast("binary").alias("value"), F.lit("labs.raw").alias("topic"), F.lit(0).alias("partition"), F.col("row_number").cast("long").alias("offset"))


@query("with " + LAB_CODED_SQL + """, b as (select *, case when reference_range = 'normal' then null when reference_range like '<%' then 0 else split_part(reference_range, '-', 1)::double end as low,
  case when reference_range = 'normal' then null when reference_range like '<%' then substr(reference_range, 2)::double else split_part(reference_range, '-', 2)::double end as high from coded)
  select sample_id, patient_id, test_type, value as result_value, unit, low as ref_low, high as ref_high, case when value < low then 'L' when value > high then 'H' else 'N' end as abnormal_flag,
    strftime(cat, '%Y-%m-%d %H:%M:%S') as collected_at, file_day::varchar as file_day, 'labs_' || file_day || '.csv' as source_file, array_to_string(message_codes, ',') as errors from b""")
def parse_labs(s, d):
    rows = val.parse_labs(_lab_messages(s, d), _known(s, d))
    return rows.select("sample_id", "patient_id", "test_type", "result_value", "unit", "ref_low", "ref_high", "abnormal_flag", at("collected_at").alias("collected_at"), F.col("file_day").cast("string").alias("file_day"), "source_file", F.array_join("error_reasons", ",").alias("errors"))


@query("with " + LAB_CODED_SQL + " select sample_id, test_type, result_value, array_to_string(codes, ',') as errors from coded")
def lab_csv_validate(s, d):
    return _coded_labs(s, d).select("sample_id", "test_type", "result_value", F.array_join("error_reasons", ",").alias("errors"))


for _name, _c in {"err_missing_blank": "missing:unit", "err_unknown_test": "unknown_test", "err_non_numeric": "non_numeric_result", "err_implausible": "implausible_result", "err_reference_range": "bad_reference_range", "err_collected_at": "bad_collected_at", "err_file_day": "collected_outside_file_day"}.items():
    QUERIES[_name] = lambda s, d, c=_c: _coded_labs(s, d).where(F.array_contains("error_reasons", c)).select("sample_id", "test_type", "result_value")
    ORACLES[_name] = "with " + LAB_CODED_SQL + f" select sample_id, test_type, result_value from coded where list_contains(codes, '{_c}')"


@query("with " + fx.LABS_SQL + """ select sample_id, test_type, result_value, case when reference_range like '<%' then 0 else split_part(reference_range, '-', 1)::double end::double as low,
  case when reference_range like '<%' then substr(reference_range, 2)::double else split_part(reference_range, '-', 2)::double end as high from labs""")
def reference_range_parse(s, d):
    return fx.labs(s, d).withColumn("r", rules.reference_range(F.col("reference_range"))).select("sample_id", "test_type", "result_value", "r.low", "r.high")


@query("with " + fx.LABS_SQL + """, b as (select *, case when reference_range like '<%' then 0 else split_part(reference_range, '-', 1)::double end as low,
  case when reference_range like '<%' then substr(reference_range, 2)::double else split_part(reference_range, '-', 2)::double end as high from labs)
  select test_type, case when result_value < low then 'L' when result_value > high then 'H' else 'N' end as flag, count(*) as n from b group by 1, 2""")
def abnormal_flag(s, d):
    return fx.labs(s, d).groupBy("test_type", rules.abnormal_flag(F.col("result_value"), rules.reference_range(F.col("reference_range"))).alias("flag")).agg(F.count("*").alias("n"))


@query("with " + fx.LABS_SQL + " select patient_id, test_type, max_by(result_value, (collected_at, sample_id, result_value)) as result_value from labs group by 1, 2")
def lab_latest(s, d):
    return tables.resolve(fx.labs(s, d).withColumn("_v", F.col("result_value")), ["patient_id", "test_type"], ["collected_at", "sample_id", "_v"]).select("patient_id", "test_type", "result_value")


@query("with " + fx.LABS_SQL + " select sample_id, test_type, max_by(result_value, (collected_at, result_value)) as result_value from labs group by 1, 2", name="lab_results_latest_version")
def lab_versions(s, d):
    return tables.resolve(fx.labs(s, d).withColumn("_v", F.col("result_value")), ["sample_id", "test_type"], ["collected_at", "_v"]).select("sample_id", "test_type", "result_value")


@query("with " + fx.LABS_SQL + " select sample_id, test_type, min_by(result_value, (collected_at, result_value)) as result_value from labs group by 1, 2")
def upsert_resolve_first(s, d):
    return tables.resolve(fx.labs(s, d).withColumn("_v", F.col("result_value")), ["sample_id", "test_type"], ["collected_at", "_v"], first=True).select("sample_id", "test_type", "result_value")


@query("with " + fx.LABS_SQL + f" select patient_id, test_type, max_by(result_value, (collected_at, sample_id, result_value)) as result_value, strftime(min(collected_at), {FMT}) as first_seen, strftime(max(collected_at), {FMT}) as last_seen from labs group by 1, 2")
def upsert_touch(s, d):
    log = fx.labs(s, d).select("patient_id", "test_type", "collected_at", "sample_id", "result_value")
    seen = tables.touched(log, ["patient_id", "test_type"], ["collected_at", "sample_id", "result_value"], "collected_at")
    return seen.select("patient_id", "test_type", "result_value", at("first_seen").alias("first_seen"), at("last_seen").alias("last_seen"))


@query("with " + fx.LABS_SQL + " select patient_id, count(*) as n from labs where collected_at > timestamp '2024-01-10' and collected_at <= timestamp '2024-01-12' group by 1")
def bounded_lab_scan(s, d):
    return fx.labs(s, d).where("collected_at > timestamp'2024-01-10 00:00:00' and collected_at <= timestamp'2024-01-12 00:00:00'").groupBy("patient_id").agg(F.count("*").alias("n"))


def _lab_files(s, d):
    rows = _coded_labs(s, d).withColumn("source_file", F.concat(F.lit("labs_"), F.col("file_day").cast("string"), F.lit(".csv")))
    return tables.file_duplicates(rows.withColumn("row_number", F.concat_ws("|", "collected_at", "result_value", "patient_id")))


_FILES_SQL = LAB_CODED_SQL + """,
filed as (select *, 'labs_' || file_day || '.csv' as source_file, len(codes) = 0 as good, collected_at || '|' || result_value || '|' || patient_id as rn from coded),
dups as (select *, row_number() over (partition by source_file, sample_id, test_type, good order by rn) as nth from filed),
fstats as (select source_file, count(*) as rows_total, count(*) filter (where good and nth = 1) as rows_valid from dups group by 1)"""


@query("with " + _FILES_SQL + " select source_file, rows_total, rows_valid, rows_total - rows_valid as rows_rejected, round((rows_total - rows_valid)::double / rows_total, 6) as reject_rate from fstats")
def lab_file_stats(s, d):
    return tables.file_stats(_lab_files(s, d)).withColumn("reject_rate", F.round("reject_rate", 6))


@query("with " + _FILES_SQL + " select source_file, case when good then 'duplicate_row' else codes[1] end as reason, count(*) as n from dups where not (good and nth = 1) group by 1, 2")
def lab_reject_reasons(s, d):
    return tables.reject_reasons(_lab_files(s, d))


@query("with " + _FILES_SQL + " select source_file, case when (rows_total - rows_valid)::double / rows_total > 0.02 then 'quarantined' else 'loaded' end as status from fstats")
def lab_file_decision(s, d):
    return tables.file_decision(tables.file_stats(_lab_files(s, d)), 0.02).select("source_file", "status")


@query("with " + _FILES_SQL + " select source_file, count(*) filter (where good and nth > 1) as duplicates from dups group by 1")
def lab_duplicates(s, d):
    return _lab_files(s, d).groupBy("source_file").agg(F.count_if(F.array_contains("error_reasons", "duplicate_row")).alias("duplicates"))


@query("with " + _FILES_SQL + " select source_file, split_part(split_part(source_file, '_', 2), '.', 1) as file_day from fstats")
def file_day_parse(s, d):
    return _lab_files(s, d).select("source_file").distinct().select("source_file", tables.file_day(F.col("source_file")).cast("string").alias("file_day"))


# Report ---------------------------------------------------------------------------------------------------------------
def _report(s, d):
    """The report of all days, of hourly windows and daily alerts."""
    labs = tables.materialised(_labs(s, d))
    stats, trends, scores = _built(s, d, labs=labs)
    hourly = _built(s, d, "1 hour", trends, labs)[2]
    roster, day = fx.roster(s, d), F.to_date("window_start")
    days = tables.materialised(scores.select(day.alias("report_date")).distinct())
    grid = report.day_windows(days, roster.where("active"))
    adjust = windows.lab_adjustments(grid, labs).withColumn("report_date", F.to_date("window_start")).drop("window_start")
    latest = delivery.latest_results(windows.range_join(grid, labs, "collected_at", F.expr("interval 48 hours"), 2 * DAY))
    latest = latest.select("patient_id", F.to_date("window_start").alias("report_date"), delivery.labs_map(F.col("labs")).alias("labs"))
    ended = F.to_date(F.col("window_end") - F.expr("interval 1 microsecond"))
    came = tables.ledger_state(_ledger(s, d)).select("file_day", "status", F.when(F.dayofmonth("file_day") % 7 == 0, "late").otherwise("on_time").alias("arrival")).where(F.dayofmonth("file_day") % 5 != 0)
    return report.build_report(roster, days, report.daily_vitals(hourly, day), report.daily_trends(trends, ended), report.daily_alerts(_raised(stats, trends, scores), day), adjust, latest, came)


_ledger_events = """e as (select ts::date as file_day, event_id as seq, case when event_type = 'click' then 'duplicate' when event_id % 7 = 0 then 'missing' else 'result' end as event,
  case when event_id % 3 = 0 then 'quarantined' else 'loaded' end as status from events)"""
_H = ("stats", "ews", "within48", "latest48", "met", "adjust", "recent", "composed", "scores")
HOURLY_SQL = re.sub(rf"\b({'|'.join(_H)})\b", r"h_\1", SCORES_SQL.replace(fx.READINGS_SQL + ",", "").replace(TRENDS_SQL + ",", "").replace(fx.LABS_SQL + ",", "").replace("interval '1 day'", "interval '1 hour'"))
_tail_s, _tail_r = _score_sql("_tail")
_TAIL = "filter (where ws >= ws::date + interval '20 hours')"
VITALS_DAY_SQL = """dv as (select ws::date as report_date, patient_id, count(*) as windows, sum(n_readings)::bigint as readings, max(ews_score)::int as ews_peak, count(*) filter (where risk_tier = 'HIGH') as hours_high,
  count(*) filter (where risk_tier = 'MEDIUM') as hours_medium, max(heart_rate_max) as heart_rate_max, min(spo2_min) as spo2_min, min(systolic_bp_min) as systolic_bp_min, max(temperature_max) as temperature_max,
  """ + ", ".join(f"sum({v}_avg * n_readings) {_TAIL} / (sum(n_readings) {_TAIL})::double as {v}_tail" for v in rules.BANDS) + " from h_scores group by 1, 2)"
REPORT_SQL = ALERTS_SQL + "," + fx.ROSTER_SQL + "," + HOURLY_SQL + "," + VITALS_DAY_SQL + "," + _ledger_events + """,
led as (select file_day as report_date, coalesce(max_by(status, seq) filter (where event = 'result'), 'missing') || '/' || case when day(file_day) % 7 = 0 then 'late' else 'on_time' end as labs_status from e where day(file_day) % 5 <> 0 group by file_day),
dt as (select (we - interval '1 microsecond')::date as report_date, patient_id, count(*) filter (where trend = 'deteriorating') as deteriorating_windows, max(worse) as max_index, coalesce(max_by(trend, we) filter (where trend <> 'insufficient_data'), 'unknown') as last_trend from trends group by 1, 2),
da as (select ws::date as report_date, patient_id, """ + ", ".join(f"count(*) filter (where severity = '{x}') as alerts_{x}" for x in ("critical", "high", "medium")) + f""" from alerts group by 1, 2),
grid as (select report_date, patient_id, bed, scenario from (select distinct ws::date as report_date from scores) cross join (select * from roster where active)),
dlab as (select g.report_date, g.patient_id, l.test_type, max_by(result_value, (collected_at, sample_id, result_value)) as result_value from grid g join labs l on l.patient_id = g.patient_id
  and l.collected_at > g.report_date + interval '1 day' - interval '48 hours' and l.collected_at <= g.report_date + interval '1 day' group by 1, 2, 3),
dmet as (select *, {_pts} as pts, {_flg} as flag from dlab),
dadj as (select report_date, patient_id, least(coalesce(sum(pts), 0), 4)::int as lab_adjustment, coalesce(array_to_string(list_sort(list(flag) filter (where flag is not null)), '|'), '') as lab_flags, count(*) as tests from dmet group by 1, 2),
joined as (select * from grid left join dv using (report_date, patient_id) left join dt using (report_date, patient_id) left join da using (report_date, patient_id) left join dadj using (report_date, patient_id) left join led using (report_date)),
base as (select *, windows is not null as have, coalesce(lab_adjustment, 0) as lab_points, case when windows is not null then ({_tail_s})::int end as ews_end, windows is not null and {_tail_r} as red,
  case when windows is not null and last_trend = 'deteriorating' then 1 else 0 end as tp from joined),
tiered as (select *, ews_end + tp as vitals_score, ews_end + tp + lab_points as total_score from base),
tiers as (select *, case when not have then 'NO_DATA' else {_tier_sql('vitals_score', 'red')} end as vitals_only_tier, case when not have then 'NO_DATA' else {_tier_sql('total_score', 'red')} end as risk_tier from tiered),
report as (select report_date::varchar as report_date, patient_id, bed, scenario, coalesce(windows, 0)::bigint as windows, coalesce(readings, 0)::bigint as readings, ews_peak, """ + ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ("hours_high", "hours_medium", "deteriorating_windows", "alerts_critical", "alerts_high", "alerts_medium")) + """,
  heart_rate_max, spo2_min, systolic_bp_min, temperature_max, coalesce(last_trend, 'unknown') as last_trend, round(max_index, 4) as max_index, coalesce(tests, 0)::bigint as tests, coalesce(labs_status, 'not_received') as labs_status, ews_end, red as red_flag, tp as trend_adjustment,
  vitals_score, total_score, lab_points::int as lab_adjustment, coalesce(lab_flags, '') as lab_flags, vitals_only_tier, risk_tier,
  case when not have then 'no_data' when list_position(['LOW', 'MEDIUM', 'HIGH'], risk_tier) > list_position(['LOW', 'MEDIUM', 'HIGH'], vitals_only_tier) then 'escalated' else 'unchanged' end as tier_change from tiers)"""


def _report_cells(r):
    tests = F.coalesce(F.size(F.map_keys("labs")), F.lit(0)).cast("long")
    return r.withColumns({"report_date": F.col("report_date").cast("string"), "max_index": F.round("max_index", 4), "tests": tests, "lab_flags": F.array_join("lab_flags", "|")}).drop("labs")


@query("with " + REPORT_SQL + " select * from report order by report_date, case risk_tier when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 3 end, total_score desc nulls last, patient_id")
def daily_report(s, d):
    return _report_cells(_report(s, d))


@query("with " + REPORT_SQL + """ select report_date, count(*) as patients, """ + ", ".join(f"count(*) filter (where risk_tier = '{t}') as tier_{t.lower()}" for t in rules.TIERS) + """,
  count(*) filter (where tier_change = 'escalated') as escalated, sum(alerts_critical + alerts_high + alerts_medium)::bigint as alerts_total, count(*) filter (where last_trend = 'deteriorating') as deteriorating from report group by 1""")
def report_summary(s, d):
    return report.report_summary(_report(s, d)).withColumn("report_date", F.col("report_date").cast("string"))


@query("with " + REPORT_SQL + " select scenario, " + ", ".join(f"count(*) filter (where risk_tier = '{t}') as {t.lower()}" for t in rules.TIERS) + " from report group by 1")
def eval_crosstab(s, d):
    return _report(s, d).groupBy(F.coalesce("scenario", F.lit("unknown")).alias("scenario")).pivot("risk_tier", list(rules.TIERS)).count().fillna(0).select("scenario", *[F.col(t).alias(t.lower()) for t in rules.TIERS])


# Tables and monitors --------------------------------------------------------------------------------------------------
@query("with " + fx.ROSTER_SQL + " select patient_id, bed from roster where active")
def active_roster(s, d):
    return fx.roster(s, d).where("active").select("patient_id", "bed")


@query("with " + fx.ROSTER_SQL + " select patient_id, bed, age < 70 as active from roster")
def roster_sync(s, d):
    r = fx.roster(s, d)
    return tables.roster_sync(r.select("patient_id", "bed"), r.where("age < 70").select("patient_id", "bed"))


def _ledger(s, d):
    kind = F.when(F.col("event_type") == "click", "duplicate").when(F.col("event_id") % 7 == 0, "missing").otherwise("result")
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.to_date("ts").alias("file_day"), F.col("event_id").alias("seq"), kind.alias("event"), F.when(F.col("event_id") % 3 == 0, "quarantined").otherwise("loaded").alias("status"), (F.col("user_id") + 0).alias("rows_valid"))


@query("""with e as (select ts::date::varchar as file_day, event_id as seq, user_id as rows_valid, case when event_type = 'click' then 'duplicate' when event_id % 7 = 0 then 'missing' else 'result' end as event,
  case when event_id % 3 = 0 then 'quarantined' else 'loaded' end as status from events)
  select file_day, coalesce(max_by(status, seq) filter (where event = 'result'), 'missing') as status, coalesce(max_by(rows_valid, seq) filter (where event = 'result'), 0)::bigint as rows_valid,
  count(*) filter (where event = 'result') as deliveries, count(*) filter (where event = 'duplicate') as duplicate_deliveries from e group by 1""")
def ledger_state(s, d):
    return tables.ledger_state(_ledger(s, d)).withColumn("file_day", F.col("file_day").cast("string"))


@query("with " + fx.READINGS_SQL + ", m as (select patient_id, max(floor(epoch(event_time))::bigint) as last_seen, count(*) filter (where floor(epoch(event_time))::bigint > 1706659200 - 86400)::double / 86400.0::double as rate from readings group by 1) select patient_id, last_seen, rate, 1706659200 - last_seen > 86400 as stale from m")
def monitor_stale(s, d):
    return monitors.stale_sources(fx.readings(s, d), "patient_id", "event_time", 1706659200, DAY)


_SHARE_SQL = fx.READINGS_SQL + """, c as (select patient_id, floor(epoch(event_time))::bigint as t, count(*) as n, count(*) filter (where spo2 < 90) as m from readings group by 1, 2),
sh as (select patient_id, t, (sum(m) over w)::double / (sum(n) over w)::double as share from c window w as (partition by patient_id order by t range between 86400 preceding and current row))"""


@query("with " + _SHARE_SQL + " select patient_id, t, round(share, 6) as share, share > 0.05 as firing from sh", name="monitor_invalid_share")
def monitor_share(s, d):
    return monitors.trailing_share(fx.readings(s, d), "patient_id", "event_time", F.col("spo2") < 90, DAY, 0.05).withColumn("share", F.round("share", 6))


@query("with " + _SHARE_SQL + """, st as (select patient_id, t, share > 0.05 as firing from sh),
isl as (select *, row_number() over (partition by patient_id order by t) - row_number() over (partition by patient_id, firing order by t) as i from st)
select patient_id, min(t) as since, max(t) as until from isl where firing group by patient_id, i having max(t) - min(t) >= 43200""")
def monitor_sustained(s, d):
    share = monitors.trailing_share(fx.readings(s, d), "patient_id", "event_time", F.col("spo2") < 90, DAY, 0.05)
    return monitors.sustained(share, "patient_id", "t", "firing", DAY // 2)


@query("select 'events' as name, count(*) as n from events union all select 'lineitem', count(*) from lineitem")
def table_row_counts(s, d):
    counts = [s.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("events", "lineitem")]
    return counts[0].unionByName(counts[1])


# Serving views and ledgers ----------------------------------------------------------------------------------------------
def _acks(alerts):
    digit = F.left("alert_id", F.lit(1))
    nurse = alerts.where(digit < "8").select("alert_id", (F.col("window_end") + F.expr("interval 1 hour")).alias("acknowledged_at"), F.lit("nurse").alias("acknowledged_by"))
    doctor = alerts.where(digit < "4").select("alert_id", (F.col("window_end") + F.expr("interval 2 hours")).alias("acknowledged_at"), F.lit("doctor").alias("acknowledged_by"))
    return nurse.unionByName(doctor)


def _acknowledged(s, d):
    alerts = _alerts(s, d)
    return serving.acknowledged(alerts, _acks(alerts))


_ACK_SQL = """,
acked as (select *, left(alert_id, 1) < '8' as acknowledged, case when left(alert_id, 1) < '4' then 'doctor' when left(alert_id, 1) < '8' then 'nurse' end as acknowledged_by from alerts)"""


@query("with " + ALERTS_SQL + _ACK_SQL + " select alert_id, patient_id, acknowledged, acknowledged_by from acked")
def alerts_with_ack(s, d):
    return _acknowledged(s, d).select("alert_id", "patient_id", "acknowledged", "acknowledged_by")


@query("with " + ALERTS_SQL + _ACK_SQL + "," + fx.ROSTER_SQL + """,
live as (select patient_id, max_by(risk_tier, ws) as risk_tier from scores group by 1),
opened as (select patient_id, count(*) as n from acked where not acknowledged group by 1),
tests as (select patient_id, test_type, max(collected_at) > timestamp '2024-01-29' as counts_toward_score from labs group by 1, 2)
select patient_id, bed, risk_tier, coalesce(n, 0)::bigint as active_alerts, test_type, counts_toward_score from roster left join live using (patient_id) left join opened using (patient_id) left join tests using (patient_id)""")
def patient_detail(s, d):
    live = live_status(s, d).select("patient_id", "risk_tier")
    patients = fx.roster(s, d).select("patient_id", "bed").join(live, "patient_id", "left")
    return serving.patient_detail(patients, fx.labs(s, d), _acknowledged(s, d), F.expr(NOW))


def _live(s, d):
    live = tables.resolve(_scores(s, d).withColumn("_at", F.col("window_start")), ["patient_id"], ["_at"])
    return live.join(fx.roster(s, d).where("active").select("patient_id", "bed"), "patient_id")


_LIVE_ALL = SCORES_SQL + "," + fx.ROSTER_SQL + ", live as (select * from (select *, row_number() over (partition by patient_id order by ws desc) as nth from scores) join roster using (patient_id) where nth = 1 and active)"


@query("with " + _LIVE_ALL + """ select patient_id, bed, risk_tier, total_score, ews_score::int as ews_score, lab_adjustment, trend, round(heart_rate_avg) as hr, round(spo2_avg) as spo2,
  round(systolic_bp_avg) as sbp, round(temperature_avg, 1) as temp, array_to_string(flags, ', ') as lab_flags from live order by total_score desc, patient_id""")
def dash_patients(s, d):
    rounded = [F.round(f"{v}_avg", n).alias(a) for v, n, a in (("heart_rate", 0, "hr"), ("spo2", 0, "spo2"), ("systolic_bp", 0, "sbp"), ("temperature", 1, "temp"))]
    return _live(s, d).orderBy(F.desc("total_score"), "patient_id").select("patient_id", "bed", "risk_tier", "total_score", "ews_score", "lab_adjustment", "trend", *rounded, F.array_join("lab_flags", ", ").alias("lab_flags"))


@query("with " + _LIVE_ALL + """ select count(*) as patients_reporting, round(avg(heart_rate_avg), 1) as hr_avg, round(avg(spo2_avg), 1) as spo2_avg, round(avg(systolic_bp_avg), 1) as sbp_avg,
  round(avg(temperature_avg), 2) as temp_avg, count(*) filter (where trend = 'deteriorating') as deteriorating from live""")
def ward_averages(s, d):
    means = [F.round(F.avg(f"{v}_avg"), n).alias(a) for v, n, a in (("heart_rate", 1, "hr_avg"), ("spo2", 1, "spo2_avg"), ("systolic_bp", 1, "sbp_avg"), ("temperature", 2, "temp_avg"))]
    return _live(s, d).agg(F.count("*").alias("patients_reporting"), *means, F.count_if(F.col("trend") == "deteriorating").alias("deteriorating"))


@query("with " + REPORT_SQL + """, counted as (select report_date, risk_tier, count(*) as n, count(*) filter (where tier_change = 'escalated') as up, max(windows) as w from report group by 1, 2)
  select report_date, string_agg(risk_tier || '=' || n, ',' order by risk_tier) as tiers, sum(up)::bigint as escalated_by_labs, sum(n)::bigint as patients,
    strftime(report_date::date + interval '1 day' + to_minutes(max(w)), '%Y-%m-%d %H:%M:%S') as generated_at from counted group by report_date""")
def report_envelope(s, d):
    # a patient's row is made so many minutes after midnight as the day has windows
    made = F.date_add("report_date", 1).cast("timestamp") + F.make_dt_interval(mins=F.col("windows").cast("int"))
    text = F.array_join(F.transform(F.map_entries("tiers"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    found = serving.report_envelope(_report(s, d).withColumn("generated_at", made))
    return found.select(F.col("report_date").cast("string").alias("report_date"), text.alias("tiers"), "escalated_by_labs", "patients", at("generated_at").alias("generated_at"))


@query("with " + REPORT_SQL + """ select patient_id, vitals_only_tier, risk_tier, case when tier_change = 'escalated' then '↑ raised by labs' else '' end as change, total_score, replace(lab_flags, '|', ', ') as lab_flags
  from report where report_date = (select max(report_date) from report) order by case risk_tier when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, total_score desc nulls last, patient_id""")
def dash_lab_effect(s, d):
    return serving.lab_effect(_report(s, d))


def _gappy_ledger(s, d):
    return tables.ledger_state(_ledger(s, d).where((F.dayofmonth("file_day") % 5 != 0) & ((F.dayofmonth("file_day") % 3 != 0) | (F.col("event") != "result"))))


_GAPPY_SQL = """e as (select ts::date as file_day, event_id as seq, user_id as rows_valid, case when event_type = 'click' then 'duplicate' when event_id % 7 = 0 then 'missing' else 'result' end as event,
  case when event_id % 3 = 0 then 'quarantined' else 'loaded' end as status from events),
led as (select file_day, coalesce(max_by(status, seq) filter (where event = 'result'), 'missing') as status, coalesce(max_by(rows_valid, seq) filter (where event = 'result'), 0)::bigint as rows_valid
  from e where day(file_day) % 5 <> 0 and (day(file_day) % 3 <> 0 or event <> 'result') group by 1)"""


@query("with " + _GAPPY_SQL + " select file_day::varchar as file_day, status from led")
def ledger_missing_guard(s, d):
    return _gappy_ledger(s, d).select(F.col("file_day").cast("string").alias("file_day"), "status")


@query("with " + _GAPPY_SQL + " select file_day::varchar as file_day, status, rows_valid from led where status <> 'missing' order by led.file_day desc limit 1")
def latest_lab_file(s, d):
    return _gappy_ledger(s, d).where("status != 'missing'").orderBy(F.desc("file_day")).limit(1).select(F.col("file_day").cast("string").alias("file_day"), "status", "rows_valid")


@query("with " + _GAPPY_SQL + """, days as (select distinct ts::date as file_day from events)
  select days.file_day::varchar as file_day from days where timestamp '2024-01-31' > days.file_day + interval '34 hours' and days.file_day not in (select file_day from led where status in ('loaded', 'quarantined'))""")
def lab_missing_days(s, d):
    days = s.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("file_day")).distinct()
    return serving.missing_days(days, _gappy_ledger(s, d), F.expr(NOW)).select(F.col("file_day").cast("string").alias("file_day"))


@query("with " + _GAPPY_SQL + """, asked as (select event_id, ts, (ts::date - interval '1 day')::date as file_day from events),
late as (select event_id, case when l.file_day is not null then 0 else greatest((epoch_us(ts) - epoch_us(asked.file_day + interval '30 hours'))::double / 3600000000.0::double, 0) end as h
  from asked left join (select file_day from led where status in ('loaded', 'quarantined')) l on l.file_day = asked.file_day)
  select event_id, (h > 4)::int as overdue, round(h, 2) as hours_late, h > 2 and h <= 4 as late from late""")
def lab_overdue(s, d):
    moments = s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    asked = serving.overdue(moments.select("now").distinct(), _gappy_ledger(s, d))
    return moments.join(asked, "now").select("event_id", "overdue", "hours_late", "late")


@query("""select event_id, case when ts + to_hours(24 + event_id % 12) <= date_trunc('day', ts) + interval '31 hours' then 'on_time' else 'late' end as arrival from events""")
def lab_arrival(s, d):
    came = F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(1), (F.col("event_id") % 12).cast("int"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", tables.arrival(F.to_date("ts"), came).alias("arrival"))


@query("""with c as (select event_id, timestamp '2024-01-01' + to_microseconds((epoch_us(least(ts, timestamp '2024-01-20')) - epoch_us(timestamp '2024-01-01')) * 288) as sim, least(ts, timestamp '2024-01-20') as re from events)
  select event_id, strftime(sim, '%Y-%m-%d %H:%M:%S') as sim_time, strftime(re, '%Y-%m-%d %H:%M:%S') as real_time from c""")
def sim_time_convert(s, d):
    start = F.expr("timestamp'2024-01-01 00:00:00'")
    clock = serving.SimClock(start, start, 300, F.expr("timestamp'2024-01-20 00:00:00'"))
    sim = clock.to_sim(F.col("ts").cast("timestamp"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", at(sim).alias("sim_time"), at(clock.to_real(sim)).alias("real_time"))


def _runs(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    n, failed = F.col("event_id"), F.col("event_id") % 13 == 0
    log = e.select(
        F.col("event_type").alias("dag_id"), F.to_date("ts").cast("string").alias("run_id"), F.concat(F.lit("task"), (F.col("user_id") % 5).cast("string")).alias("task_id"), (n % 3).cast("int").alias("try_number"), n.alias("seq"),
        F.col("at").alias("started_at"), F.when(n % 11 != 0, F.timestamp_micros(F.unix_micros("at") + n % 977 * 1000000)).alias("ended_at"), F.when(failed, "failed").otherwise("success").alias("state"), F.when(failed, F.repeat(F.lit("x"), (n % 900).cast("int"))).alias("error"),
    )
    return serving.task_runs(log)


_RUNS_SQL = """runs_log as (select event_type as dag_id, ts::date::varchar as run_id, 'task' || (user_id % 5) as task_id, (event_id % 3)::int as try_number, event_id as seq, ts as started_at,
  case when event_id % 11 <> 0 then ts + to_seconds(event_id % 977) end as ended_at, case when event_id % 13 = 0 then 'failed' else 'success' end as state, case when event_id % 13 = 0 then repeat('x', (event_id % 900)::int) end as error from events),
runs as (select *, (epoch_us(ended_at) - epoch_us(started_at))::double / 1000000.0::double as duration_s from (select *, row_number() over (partition by dag_id, run_id, task_id, try_number order by seq desc) as nth from runs_log) where nth = 1)"""


@query("with " + _RUNS_SQL + " select dag_id, run_id, task_id, try_number, state, duration_s, length(left(error, 500))::int as error_chars from runs")
def pipeline_runs_state(s, d):
    return _runs(s, d).select("dag_id", "run_id", "task_id", "try_number", "state", "duration_s", F.char_length("error").alias("error_chars"))


@query("with " + _RUNS_SQL + " select dag_id, task_id, max_by(duration_s, (ended_at, run_id, try_number)) as duration_s from runs where duration_s is not null group by 1, 2")
def task_last_duration(s, d):
    return serving.last_durations(_runs(s, d)).select("dag_id", "task_id", "duration_s")


@query("with " + _RUNS_SQL + " select dag_id, task_id, count(*) as failed from runs where state = 'failed' and ended_at > timestamp '2024-01-15' group by 1, 2")
def monitor_failed_tasks(s, d):
    return serving.failed_tasks(_runs(s, d), F.expr("timestamp'2024-01-15 00:00:00'"))
