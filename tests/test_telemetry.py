"""Rule edges, windows, validation, keyed tables and streaming against hand-made rows."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import rules, validation
from pulsegrid.operators import delivery, monitors, report, tables, windows
from pulsegrid.streaming import jobs, progress

START = dt.datetime(2026, 1, 3, 8)
READING = "event_id string, patient_id string, heart_rate double, spo2 double, systolic_bp double, diastolic_bp double, temperature double, event_time timestamp, produced_at timestamp"


def reading(i, minutes, hr=80.0, spo2=97.0, sbp=120.0, dbp=75.0, temp=37.0):
    at = START + dt.timedelta(minutes=minutes)
    return (f"e{i}", "P001", hr, spo2, sbp, dbp, temp, at, at)


def band_points(vital, x):
    if x is None:
        return 0
    return next(p for top, p in rules.BANDS[vital] if top is None or x <= top)


@pytest.mark.parametrize("vital", list(rules.BANDS))
def test_points_match_a_plain_evaluator(spark, vital):
    edges = [x + e for top, _ in rules.BANDS[vital] if top is not None for x in (top,) for e in (-0.5, 0.0, 0.4)] + [None]
    df = spark.createDataFrame([(float(x) if x is not None else None,) for x in edges], "x double")
    got = [r[0] for r in df.select(rules.points(vital, F.col("x"))).collect()]
    assert got == [band_points(vital, x) for x in edges]


def test_tumbling_breaches_and_slopes(spark):
    rows = [reading(i, 5 * i, hr=80.0 + i, spo2=86.0 if i < 2 else 97.0) for i in range(12)]
    stats = windows.tumbling_stats(spark.createDataFrame(rows, READING)).first()
    assert (stats["n_readings"], stats["breach_SPO2_LOW"]) == (12, 2)
    slopes = windows.sliding_slopes(spark.createDataFrame(rows, READING)).where("n_readings = 12").first()
    assert slopes["heart_rate_slope"] == pytest.approx(12.0)
    assert windows.sliding_slopes(spark.createDataFrame(rows[:1], READING)).first()["heart_rate_slope"] is None
    assert windows.tumbling_stats(spark.createDataFrame([], READING)).count() == 0


def test_one_blip_raises_no_alert(spark):
    rows = [reading(i, 5 * i, spo2=85.0 if i == 3 else 97.0) for i in range(12)]
    assert windows.threshold_alerts(windows.tumbling_stats(spark.createDataFrame(rows, READING))).count() == 0


def test_lab_look_back_boundaries(spark):
    end = START + dt.timedelta(hours=1)
    w = spark.createDataFrame([("P001", START, end)], "patient_id string, window_start timestamp, window_end timestamp")
    at = lambda h: end + dt.timedelta(hours=h)
    labs = spark.createDataFrame([("P001", "LACTATE", 1.0, at(-30), "a"), ("P001", "LACTATE", 5.0, at(-2), "b"), ("P001", "CRP", 200.0, at(-48), "c"), ("P001", "WBC", 20.0, at(1), "d"), ("P001", "TROPONIN", 20.0, at(0), "e")], "patient_id string, test_type string, result_value double, collected_at timestamp, sample_id string")
    row = windows.lab_adjustments(w, labs).first()
    assert (row["lab_adjustment"], row["lab_flags"]) == (3, ["lactate_very_high", "troponin_raised"])


GOOD = {"schema_version": 1, "event_id": "e", "patient_id": "P001", "heart_rate": 80, "spo2": 97, "systolic_bp": 120, "diastolic_bp": 75, "temperature": 37, "timestamp": "2026-01-03T08:00:00Z", "produced_at": "2026-01-03T08:00:00.5Z"}


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []), ({"heart_rate": "78"}, ["type:heart_rate"]), ({"heart_rate": True}, ["type:heart_rate"]), ({"heart_rate": None}, ["missing:heart_rate"]), ({"spo2": 101}, ["range:spo2"]),
        ({"systolic_bp": 75}, ["bp_inverted"]), ({"patient_id": 7}, ["bad_patient_id"]), ({"patient_id": "P950"}, ["unknown_patient"]), ({"timestamp": "2026-01-03T08:00:00"}, ["bad_timestamp:timestamp"]),
        ("[1,2]", ["not_an_object"]), ("{not json", ["invalid_json"]), ("", ["invalid_json"]),
    ],
)
def test_vitals_contract(spark, change, codes):
    text = change if isinstance(change, str) else json.dumps(GOOD | change)
    raw = spark.createDataFrame([(b"P001", text.encode(), "vitals.raw", 0, 0)], "key binary, value binary, topic string, partition int, offset long")
    known = spark.createDataFrame([("P001",)], "patient_id string")
    assert validation.parse_vitals(raw, known).first()["error_reasons"] == codes


def test_reference_ranges(spark):
    df = spark.createDataFrame([("4.0-11.0",), ("<5",), ("5-4",), ("normal",), (None,)], "t string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(rules.reference_range(F.col("t"))).collect()]
    assert got == [(4.0, 11.0), (0.0, 5.0), None, None, None]


def test_files_of_a_folder(spark, tmp_path):
    head = "sample_id,patient_id,test_type,result_value,unit,reference_range,collected_at\n"
    rest = 'CRP,3,mg/L,<5,2026-01-03T08:00:00Z\n'
    rows = ["a,P001," + rest, "\n", '"b, 2",P001,"CRP",3,mg/L,"<5",2026-01-03T08:00:00Z\n', "c,P001," + rest.strip() + ",more\n", "d,P001," + rest.strip() + ",\n", "e,P001,CRP\n", "a,P001, crp" + rest[3:], "f,P950," + rest, "g,P001,CRP,3,mg/L,<5,2026-01-03T08:00:00\n"]
    (tmp_path / "labs_2026-01-03.csv").write_text(head + "".join(rows))
    (tmp_path / "labs_2026-01-04.csv").write_text("wrong\nx\n")
    (tmp_path / "labs_2026-01-05.csv").write_bytes(b"\xff\xfe")
    (tmp_path / "labs_2026-01-06.csv").write_text(head)
    known = spark.createDataFrame([("P001",)], "patient_id string")
    rows = tables.csv_rows(tables.waiting_files(spark, str(tmp_path)))
    checked = tables.checked_rows(rows, known)
    got = {r["row_number"]: r for r in checked.collect()}
    assert {n: r["error_reasons"] for n, r in got.items()} == {
        1: [], 2: [], 3: ["wrong_column_count"], 4: ["wrong_column_count"], 5: [f"missing:{c}" for c in ("result_value", "unit", "reference_range", "collected_at")],
        6: ["duplicate_row"], 7: ["unknown_patient"], 8: ["bad_collected_at"],
    }
    assert got[2]["sample_id"] == "b, 2"
    files = {r["source_file"]: r for r in tables.file_checks(rows, checked, 0.8).collect()}
    assert [(files[f"labs_2026-01-0{i}.csv"]["status"], files[f"labs_2026-01-0{i}.csv"]["rows_total"], files[f"labs_2026-01-0{i}.csv"]["good_header"]) for i in (3, 4, 5, 6)] == [("loaded", 8, True), ("quarantined", 0, False), ("quarantined", 0, False), ("quarantined", 0, True)]
    assert {tuple(r)[1:] for r in tables.reject_reasons(checked).collect()} == {("wrong_column_count", 2), ("missing:result_value", 1), ("duplicate_row", 1), ("unknown_patient", 1), ("bad_collected_at", 1)}


LAB = {"sample_id": "s", "patient_id": "P001", "test_type": " crp ", "result_value": 181.9, "unit": "mg/L", "reference_range": "<5", "collected_at": "2026-01-03T08:00:00Z", "schema_version": 1, "source_file": "labs_2026-01-03.csv", "file_day": "2026-01-03", "row_number": 1}


@pytest.mark.parametrize(
    ("change", "codes", "flag"),
    [
        ({}, [], "H"), ({"test_type": "WBC", "result_value": 3.1, "reference_range": "4.0-11.0"}, [], "L"), ({"test_type": "POTASSIUM", "result_value": 4.2, "reference_range": "3.5-5.3"}, [], "N"),
        ({"result_value": "181.9"}, ["non_numeric_result"], "H"), ({"result_value": None}, ["missing:result_value"], "N"), ({"unit": " "}, ["missing:unit"], "H"), ({"row_number": None}, ["missing:row_number"], "H"),
        ({"patient_id": "P950"}, ["unknown_patient"], "H"), ({"patient_id": 7}, ["bad_patient_id"], "H"), ({"test_type": "GLU"}, ["unknown_test"], "H"), ({"result_value": 501}, ["implausible_result"], "H"),
        ({"reference_range": "normal"}, ["bad_reference_range"], "N"), ({"collected_at": "2026-01-03 08:00:00"}, ["bad_collected_at"], "H"), ({"file_day": "2026-01-04"}, ["collected_outside_file_day"], "H"), ("[1]", ["not_an_object"], "N"), ("{", ["invalid_json"], "N"),
    ],
)
def test_lab_contract(spark, change, codes, flag):
    text = change if isinstance(change, str) else json.dumps(LAB | change)
    raw = spark.createDataFrame([(b"P001", text.encode(), "labs.raw", 0, 0)], "key binary, value binary, topic string, partition int, offset long")
    row = validation.parse_labs(raw, spark.createDataFrame([("P001",)], "patient_id string")).first()
    assert (row["error_reasons"], row["abnormal_flag"]) == (codes, flag)


def test_resolve_and_monitors(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in tables.resolve(log, ["k"], ["n"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r["k"], r["v"]) for r in tables.resolve(log, ["k"], ["n"], first=True).collect()} == {("a", "x"), ("b", "z")}
    states = spark.createDataFrame([("q", t, f) for t, f in ((0, True), (30, True), (60, True), (70, False), (80, True))], "k string, t long, f boolean")
    assert [tuple(r) for r in monitors.sustained(states, "k", "t", "f", 60).collect()] == [("q", 0, 60)]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    known = spark.createDataFrame([("P001",)], "patient_id string")
    schema = "key binary, value binary, topic string, partition int, offset long"
    rows = []
    for i in range(24):
        at = (START + dt.timedelta(minutes=10 * i)).strftime("%Y-%m-%dT%H:%M:%SZ")
        body = json.dumps(GOOD | {"event_id": f"e{i}", "heart_rate": 80 + i, "timestamp": at, "produced_at": at}).encode()
        rows += [(b"P001", body, "vitals.raw", 0, i)] * (2 if i % 5 == 0 else 1)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = jobs.source(spark, "parquet", schema, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.start(jobs.windowed(raw, known), "windows", jobs.write_log(out), str(tmp_path / "ckpt"), "update").awaitTermination()
    log = spark.read.parquet(out)
    got = {(r["window_start"], r["n_readings"], r["heart_rate_avg"]) for r in tables.resolve(log.withColumnRenamed("batch_id", "b"), ["patient_id", "window_start"], ["b"]).collect()}
    batch = windows.tumbling_stats(validation.valid_vitals(validation.parse_vitals(spark.createDataFrame(rows, schema), known)).dropDuplicates(["event_id"]))
    assert got == {(r["window_start"], r["n_readings"], r["heart_rate_avg"]) for r in batch.collect()}
    before = log.count()
    jobs.write_log(out)(batch.select(*[c for c in log.columns if c not in ("epoch", "batch_id")]), 0)
    assert spark.read.parquet(out).where("batch_id = 0").count() == batch.count() <= before


def test_repeated_deliveries(spark):
    day = dt.date(2026, 1, 3)
    came = [("a", "quarantined"), ("b", "loaded"), ("b", "loaded"), ("c", "quarantined"), ("b", "loaded"), ("d", "loaded"), ("b", "loaded")]
    files = spark.createDataFrame([(day, i, c, x) for i, (c, x) in enumerate(came)], "file_day date, seq int, checksum string, decision string")
    got = [r["outcome"] for r in delivery.deliveries(files).orderBy("seq").collect()]
    assert got == ["quarantined", "loaded", "duplicate", "quarantined_file_only", "duplicate", "loaded", "loaded"]


def test_six_significant_digits(spark):
    values = [0.0, 12.0, 0.1, 181.9, 1234567.0, 3.14159265, 0.00123456789, 99999.94]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(delivery.significant(F.col("v"))).collect()]
    assert [float(x) for x in got] == [float(f"{v:g}") for v in values] and got[:4] == ["0", "12", "0.1", "181.9"]


def test_source_lag(spark):
    cases = [('{"t":{"0":10,"1":5}}', '{"t":{"0":4,"1":9}}', 6), ('{"t":{"0":10}}', "{}", 0), (None, None, 0), ("broken", '{"t":{"0":1}}', 0)]
    df = spark.createDataFrame([([(a, b)], n) for a, b, n in cases], "sources array<struct<latest: string, end: string>>, expected long")
    assert all(r["lag"] == r["expected"] for r in progress.source_lag(df).collect())


def test_progress_log_and_late_rows(spark, tmp_path):
    known = spark.createDataFrame([("P001",)], "patient_id string")
    schema = "key binary, value binary, topic string, partition int, offset long"

    def put(n, hours):
        rows = []
        for i, h in enumerate(hours):
            when = (START + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")
            rows.append((b"P001", json.dumps(GOOD | {"event_id": f"e{n}-{i}", "timestamp": when, "produced_at": when}).encode(), "vitals.raw", 0, n * 100 + i))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))

    log = progress.ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        for n, hours in enumerate(([0, 1, 2], [9, 10], [0.5, 10.5], [11, 12])):  # 0.5 comes hours after the watermark passed it
            put(n, hours)
            raw = jobs.source(spark, "parquet", schema, str(tmp_path / "in"), recursiveFileLookup="true")
            jobs.start(jobs.trends(raw, known), "trends", jobs.write_log(str(tmp_path / "out")), str(tmp_path / "ckpt")).awaitTermination()
        for _ in range(100):
            done = progress.read_log(spark, str(tmp_path / "progress")) if (tmp_path / "progress").exists() else None
            if done is not None and done.agg(F.sum("input_rows")).first()[0] == 9:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    share = progress.late_share(done).first()
    assert (share["name"], share["rows"]) == ("trends", 9) and share["dropped"] >= 1
    windows_out = spark.read.parquet(str(tmp_path / "out"))
    assert windows_out.count() == windows_out.select("patient_id", "window_start").distinct().count()  # each window once
    first = windows_out.where(F.col("window_start") == START).first()
    assert first["n_readings"] == 3  # without the late row


def test_ward_goes_on_after_a_crash(spark, tmp_path):
    """All five queries: a crash between publishing and storing alerts publishes again and loses nothing; a replay adds nothing."""
    schema = "key binary, value binary, topic string, partition int, offset long"

    def put(topic, n, bodies):
        spark.createDataFrame([(b"P001", json.dumps(x).encode() if isinstance(x, dict) else x, topic, 0, n * 1000 + i) for i, x in enumerate(bodies)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / topic))

    def vitals(n, hours, **change):
        when = [(START + dt.timedelta(minutes=60 * h + 5 * i)).strftime("%Y-%m-%dT%H:%M:%SZ") for h in hours for i in range(12)]
        return [GOOD | {"event_id": f"e{n}-{i}", "timestamp": t, "produced_at": t} | change for i, t in enumerate(when)]

    sent, pending, broken = [], [], [True]

    def publish(messages):
        rows = messages.collect()
        sent.extend((r["topic"], r["value"]) for r in rows)
        pending.extend(r["value"].encode() for r in rows if r["topic"] == "deadletter")

    def ward():
        own = jobs.Ward(spark, str(tmp_path / "out"), str(tmp_path / "ckpt"), publish, lambda: spark.createDataFrame([("P001",)], "patient_id string"))
        whole = own.log

        def log(name):
            if name == "window_alerts" and broken[0]:
                raise RuntimeError("crash before alerts are stored")
            return whole(name)

        own.log = log
        return own

    def run():
        put("letters", len(sent), [pending.pop() for _ in range(len(pending))])
        stream = lambda topic: jobs.source(spark, "parquet", schema, str(tmp_path / topic))
        jobs.await_all(ward().start(stream("vitals"), stream("labs"), stream("letters")))

    put("labs", 0, [LAB, LAB | {"sample_id": "x", "unit": ""}])
    put("vitals", 0, vitals(0, [0], spo2=85) + [b"broken"])
    with pytest.raises(Exception, match="crash before alerts"):
        run()
    broken[0] = False
    run()
    put("vitals", 1, vitals(1, [1, 9]))
    for _ in range(2):
        run()
    table = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    alerts = [json.loads(v)["alert_id"] for t, v in sent if t == "alerts"]
    stored = {r["alert_id"] for r in table("window_alerts").collect()}
    assert set(alerts) == stored and len(stored) >= 1 and len(alerts) == 2 * len(stored)  # each before the crash, and after it
    live = tables.newest_epoch(table("live_status"), ["patient_id"], ["window_start"]).first()
    assert live["window_start"] == START + dt.timedelta(hours=9)
    first = tables.newest_epoch(table("windows"), ["patient_id", "window_start"]).where(F.col("window_start") == START).first()
    assert first["n_readings"] == 12 and first["ews_red_flag"] and first["lab_adjustment"] == 1
    assert table("lab_results").count() == 1 and jobs.latency_seconds(table("latency")).where("latency > 0").count() >= 2
    reasons = {tuple(r["error_reasons"]) for r in table("dead_letters").collect()}
    assert reasons == {("invalid_json",), ("missing:unit",)}
    assert {(r["outcome"], r["n"]) for r in table("vitals_outcomes").where("batch_id = 0").collect()} == {("valid", 12), ("invalid_json", 1)}


def test_lab_files_are_published_before_they_are_marked(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    head = "sample_id,patient_id,test_type,result_value,unit,reference_range,collected_at\n"
    good = "".join(f"s{i},P001,CRP,3,mg/L,<5,2026-01-03T08:00:00Z\n" for i in range(9))
    (folder / "labs_2026-01-03.csv").write_text(head + good + "s9,P001,CRP,oops,mg/L,<5,2026-01-03T08:00:00Z\n")
    (folder / "labs_2026-01-04.csv").write_text("wrong\n")
    sent, broken = [], [True]
    ward = jobs.Ward(spark, str(tmp_path / "out"), str(tmp_path / "ckpt"), lambda m: sent.extend(map(tuple, m.select("topic", "key").collect())), lambda: spark.createDataFrame([("P001",)], "patient_id string"))
    whole = ward.log
    ward.log = lambda name: whole("other" if broken[0] and 1 / 0 else name)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        ward.start_files(str(folder)).awaitTermination()
    broken[0] = False
    for _ in range(2):
        ward.start_files(str(folder)).awaitTermination()
    assert sorted(set(sent)) == [("deadletter", "labs"), ("labs.raw", "P001")] and sent.count(("labs.raw", "P001")) == 18
    ledger = {r["source_file"]: (r["status"], r["rows_valid"], r["rows_total"]) for r in ward.stored("file_ledger").table(jobs.FILE_LOG).collect()}
    assert ledger == {"labs_2026-01-03.csv": ("loaded", 9, 10), "labs_2026-01-04.csv": ("quarantined", 0, 0)}


def test_epochs_publishing_and_report_days(spark, tmp_path):
    log = spark.createDataFrame([("a", "old", 0, 5), ("a", "new", 1, 0), ("b", "gone", 0, 1)], "k string, v string, epoch int, batch_id long")
    assert [tuple(r) for r in tables.newest_epoch(log, ["k"]).collect()] == [("a", "new")]
    messages = spark.createDataFrame([("k", "v", "t")], "key string, value string, topic string")
    for _ in range(2):
        jobs.publisher("json", str(tmp_path / "topic"))(messages)
    assert spark.read.json(str(tmp_path / "topic")).count() == 2
    jobs.configure(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    day = lambda d, n: spark.createDataFrame([(dt.date(2026, 1, d), f"P{i}") for i in range(n)], "report_date date, patient_id string")
    for rows in (day(3, 2).union(day(4, 2)), day(4, 5)):
        report.write_report(rows, str(tmp_path / "report"))
    assert {(r["report_date"].day, r["count"]) for r in spark.read.parquet(str(tmp_path / "report")).groupBy("report_date").count().collect()} == {(3, 2), (4, 5)}


def test_report_rows_and_order(spark, tmp_path):
    """Hourly windows: only the last four hours of a day score it; order by tier, score and id; a patient without windows."""
    roster = spark.createDataFrame([(f"P00{i}", f"B0{i}", "stable", i != 4) for i in range(1, 5)], "patient_id string, bed string, scenario string, active boolean")
    day = dt.datetime(2026, 1, 3)
    rows = []
    for i, (pid, hr) in enumerate((("P001", [80.0] * 24), ("P002", [80.0] * 20 + [135.0] * 4))):
        rows += [(f"{pid}-{h}", pid, x, 97.0, 120.0, 75.0, 37.0, day + dt.timedelta(hours=h), day + dt.timedelta(hours=h)) for h, x in enumerate(hr)]
    scored = windows.with_early_warning(windows.tumbling_stats(spark.createDataFrame(rows, READING))).withColumn("risk_tier", rules.tier(F.col("ews_score"), F.col("ews_red_flag")))
    days = spark.createDataFrame([(day.date(),)], "report_date date")
    none = lambda schema: spark.createDataFrame([], f"report_date date, patient_id string, {schema}")
    trends = spark.createDataFrame([(day.date(), "P002", 3, 6.0, "deteriorating")], "report_date date, patient_id string, deteriorating_windows long, max_index double, last_trend string")
    adjust = spark.createDataFrame([(day.date(), "P002", 4, ["crp_very_high"]), (day.date(), "P003", 2, ["wbc_high"])], "report_date date, patient_id string, lab_adjustment int, lab_flags array<string>")
    ledger = spark.createDataFrame([(day.date(), "loaded", "late")], "file_day date, status string, arrival string")
    labs = none("labs map<string, struct<value: double, unit: string, `range`: string, flag: string, collected_at: timestamp>>")
    done = report.build_report(roster, days, report.daily_vitals(scored, F.to_date("window_start")), trends, none("alerts_critical long, alerts_high long, alerts_medium long"), adjust, labs, ledger)
    got = done.collect()
    assert [r["patient_id"] for r in got] == ["P002", "P001", "P003"] and done.columns == [*report.COLUMNS, "scenario"]
    assert (got[0]["ews_end"], got[0]["vitals_score"], got[0]["total_score"], got[0]["vitals_only_tier"], got[0]["risk_tier"], got[0]["tier_change"]) == (3, 4, 8, "MEDIUM", "HIGH", "escalated")
    assert (got[1]["risk_tier"], got[1]["labs_status"], got[1]["windows"]) == ("LOW", "loaded/late", 24)
    assert (got[2]["risk_tier"], got[2]["total_score"], got[2]["lab_adjustment"], got[2]["windows"], got[2]["last_trend"]) == ("NO_DATA", None, 2, 0, "unknown")
    delivery.write_report_csv(done, str(tmp_path / "csv"))
    cells = spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()
    assert [r["patient_id"] for r in cells] == ["P002", "P001", "P003"] and cells[0]["lab_flags"] == "crp_very_high"
