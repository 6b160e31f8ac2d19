"""Keyed logs, file deliveries, database tables and monitors: against plain versions, through crashes and replays."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import delivery, monitors, tables
from pulsegrid.sources.jdbc import Database
from pulsegrid.streaming import jobs, logs
from tests.test_telemetry import GOOD, START

SCHEMA = "k string, at timestamp, v int"
DAYS = [dt.datetime(2026, 1, d, 12) for d in range(1, 29)]


def put(log, spark, batch_id, rows):
    log.append(spark.createDataFrame(rows, SCHEMA).coalesce(1), batch_id)


def test_a_log_is_the_last_version_of_each_key_whatever_is_compacted(spark, tmp_path):
    """Versions that move to another day, replays, and look-ups by range against a dictionary."""
    rnd = random.Random(3)
    log = logs.KeyedLog(spark, str(tmp_path / "t"), ("k",), "at", moves=True, tail=3)
    want = {}
    for n in range(11):
        rows = {f"k{rnd.randint(0, 15)}": (rnd.choice(DAYS), rnd.randint(0, 99)) for _ in range(4)}
        put(log, spark, n, [(k, *v) for k, v in rows.items()])
        if n % 4 == 1:
            put(log, spark, n, [(k, *v) for k, v in rows.items()])  # a replay
        want |= rows
        low, high = sorted(rnd.sample(DAYS, 2))
        got = {r["k"]: (r["at"], r["v"]) for r in log.table(SCHEMA, low, high).collect()}
        assert got == {k: v for k, v in want.items() if low < v[0] <= high}
    assert {r["k"]: (r["at"], r["v"]) for r in log.table(SCHEMA).collect()} == want
    assert log.manifest().upto >= 6 and len(log.batches(log.manifest())) <= 4


def test_many_batches_are_read_as_a_few_files_of_the_days_asked_for(spark, tmp_path):
    log = logs.KeyedLog(spark, str(tmp_path / "t"), ("k",), "at", tail=1000)
    for n, day in enumerate(DAYS):
        put(log, spark, n, [(f"k{n}", day, n)])
    log.compact(26, SCHEMA)
    found = log.table(SCHEMA, DAYS[4], DAYS[6])
    assert {r["k"] for r in found.collect()} == {"k5", "k6"}
    names = [f for f in found.inputFiles() if "_days" in f]
    assert {f.split("log_day=")[1][:10] for f in names} == {"2026-01-05", "2026-01-06", "2026-01-07"} and len(names) == 3
    log.compact(27, SCHEMA)
    assert len(log._tail.names()) == 1  # batches of the compaction before are gone, those of the last wait for their readers


def test_a_crash_while_compacting_loses_nothing(spark, tmp_path, monkeypatch):
    log = logs.KeyedLog(spark, str(tmp_path / "t"), ("k",), "at", tail=1000)
    for n in range(4):
        put(log, spark, n, [(f"k{n % 3}", DAYS[n % 3], n)])
    before = sorted(map(tuple, log.table(SCHEMA).collect()))
    for at in ("publish", "remove"):
        with monkeypatch.context() as m:
            m.setattr(logs.Folder, at, lambda *a: 1 / 0)
            if at == "publish":
                with pytest.raises(ZeroDivisionError):
                    log.compact(2, SCHEMA)
                assert log.manifest().upto == -1
        assert sorted(map(tuple, log.table(SCHEMA).collect())) == before
    log.compact(2, SCHEMA)
    assert log.manifest().upto == 2 and sorted(map(tuple, log.table(SCHEMA).collect())) == before
    put(log, spark, 2, [("k9", DAYS[9], 9)])  # a replay of a batch that the snapshot holds changes nothing
    assert sorted(map(tuple, log.table(SCHEMA).collect())) == before


def ward(spark, tmp_path, sent, **more):
    return jobs.Ward(spark, str(tmp_path / "out"), str(tmp_path / "ckpt"), lambda m: sent.extend(map(tuple, m.select("topic", "key", "value").collect())), lambda: spark.createDataFrame([("P001",)], "patient_id string"), **more)


def test_alerts_are_looked_up_in_the_days_of_a_batch(spark, tmp_path):
    sent = []
    own = ward(spark, tmp_path, sent, tail=2)
    alert = lambda n: (f"P{n:03d}", DAYS[n], DAYS[n], "T", "high", 1.0, 1.0, "m", f"a{n}")
    for n in range(9):
        own.raise_alerts(spark.createDataFrame([alert(n), alert(max(0, n - 1))] if n else [alert(0)], jobs.ALERT_LOG), n, "trend_alerts")
    assert [json.loads(v)["alert_id"] for _, _, v in sent] == [f"a{n}" for n in range(9)]  # each once
    found = own.stored("trend_alerts").rows(jobs.ALERT_LOG, DAYS[2].date(), DAYS[2].date())
    snapshot = [f for f in found.inputFiles() if "_days" in f]
    assert len(snapshot) == 1 and "log_day=2026-01-03" in snapshot[0]
    own.raise_alerts(spark.createDataFrame([], jobs.ALERT_LOG), 9, "trend_alerts")


HEAD = "sample_id,patient_id,test_type,result_value,unit,reference_range,collected_at\n"


def lab_file(*results, bad=0):
    row = "s{},P001,CRP,{},mg/L,<5,2026-01-03T08:00:00Z\n"
    return HEAD + "".join(row.format(i, x) for i, x in enumerate(results)) + "".join(row.format(f"b{i}", "5d") for i in range(bad))


def test_files_that_come_again_under_their_name(spark, tmp_path):
    """A duplicate, a bad and a corrected delivery of one day, and a crash after publishing."""
    folder, sent, broken = tmp_path / "landing", [], [False]
    folder.mkdir()
    own = ward(spark, tmp_path, sent)
    whole = own.log
    own.log = lambda name: whole("other" if broken[0] and 1 / 0 else name)

    def deliver(text):
        (folder / "labs_2026-01-03.csv").write_text(text)
        own.start_files(str(folder)).awaitTermination()
        assert not list(folder.iterdir())
        done = [json.loads(v)["result_value"] for t, _, v in sent if t == "labs.raw"]
        sent.clear()
        r = own.file_ledger().first()
        return done, (r["status"], r["rows_valid"], r["deliveries"], r["duplicate_deliveries"])

    assert deliver(lab_file(1, 2, bad=9)) == ([], ("quarantined", 2, 1, 0))
    assert deliver(lab_file(1, 2)) == ([1.0, 2.0], ("loaded", 2, 2, 0))
    assert deliver(lab_file(1, 2)) == ([], ("loaded", 2, 2, 1))
    assert deliver(lab_file(7, bad=9)) == ([], ("loaded", 2, 2, 1))
    broken[0] = True
    with pytest.raises(Exception, match="ZeroDivisionError"):
        deliver(lab_file(1, 3, 4))
    broken[0] = False
    assert [json.loads(v)["result_value"] for t, _, v in sent if t == "labs.raw"] == [1.0, 3.0, 4.0]
    sent.clear()
    own.start_files(str(folder)).awaitTermination()  # replays, publishes again, then marks
    assert [json.loads(v)["result_value"] for t, _, v in sent if t == "labs.raw"] == [1.0, 3.0, 4.0]
    sent.clear()
    assert deliver(lab_file(1, 3, 4)) == ([], ("loaded", 3, 3, 2))
    assert deliver(lab_file(1, 2)) == ([1.0, 2.0], ("loaded", 2, 4, 2))


def test_records_with_quoted_line_ends_and_numbers_with_suffixes(spark, tmp_path):
    tail = "mg/L,<5,2026-01-03T08:00:00Z\n"
    body = ['"a\n1",P001,CRP,3,' + tail, "b,P001,CRP,5d," + tail, "c,P001,CRP,5.0f," + tail, '"d ""x""",P001,"CRP", 1e0 ,' + tail, 'e,P0"01,CRP,nan,' + tail, "\r\n", "f,P001,CRP,1_0," + tail, 'g,P001,CRP,3,"mg/L,<5']
    (tmp_path / "labs_2026-01-03.csv").write_text(HEAD + "".join(body), newline="")
    (tmp_path / "labs_2026-01-04.csv").write_text("\n" + HEAD)
    rows = tables.checked_rows(tables.csv_rows(tables.waiting_files(spark, str(tmp_path))))
    got = {r["row_number"]: (r["sample_id"], r["error_reasons"]) for r in rows.collect()}
    assert got == {1: ("a\n1", []), 2: ("b", ["non_numeric_result"]), 3: ("c", ["non_numeric_result"]), 4: ('d "x"', []), 5: ("e", ["bad_patient_id", "implausible_result"]), 6: ("f", []), 7: ("g", ["missing:reference_range", "missing:collected_at"])}
    numbers = [json.loads(r["value"])["result_value"] for r in delivery.lab_events(rows).orderBy("value").collect()]
    assert sorted(numbers) == [1.0, 3.0, 10.0]


def test_deliveries_are_scanned_in_blocks(spark):
    rnd = random.Random(5)
    came = [(dt.date(2026, 1, rnd.randint(1, 2)), n, rnd.choice("abc"), rnd.choice(["loaded", "quarantined"])) for n in range(60)]
    files = spark.createDataFrame(came, "file_day date, seq long, checksum string, decision string")
    good, want = {}, []
    for day, n, c, d in came:
        want.append("duplicate" if good.get(day) == c else "quarantined_file_only" if d != "loaded" and day in good else d)
        if d == "loaded":
            good[day] = c
    for block in (1, 7, 1000):
        assert [r["outcome"] for r in delivery.deliveries(files, block).orderBy("seq").collect()] == want


def test_database_tables(spark, tmp_path):
    db = Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    db.run('CREATE TABLE labs ("k" BIGINT PRIMARY KEY, "day" DATE, "v" DOUBLE)')
    rows = lambda *r: spark.createDataFrame(r, "k long, day date, v double")
    day = lambda n: dt.date(2026, 1, n)
    assert db.read("labs", "k").count() == 0
    db.upsert(rows(*((n, day(1 + n % 20), float(n)) for n in range(100))), "labs", ["k"])
    db.upsert(rows((5, day(9), -1.0), (200, day(9), 2.0)), "labs", ["k"])
    db.upsert(rows((5, day(9), -7.0), (201, day(9), 3.0)), "labs", ["k"], update=())
    db.upsert(rows((6, day(9), -7.0), (7, day(9), 70.0)), "labs", ["k"], guard='s."v" >= t."v"')
    whole = db.read("labs", "k", 4)
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 102
    assert {r["k"]: r["v"] for r in whole.where("k in (5, 6, 7, 200, 201)").collect()} == {5: -1.0, 6: 6.0, 7: 70.0, 200: 2.0, 201: 3.0}
    plan = whole.where("day > date'2026-01-18'").select("k")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(day), *GreaterThan(day,2026-01-18)]" in plan
    with pytest.raises(Exception, match="(?i)duplicate"):
        db.run('INSERT INTO labs ("k") VALUES (1000)', 'INSERT INTO labs ("k") VALUES (5)')
    assert db.read("labs").where("k = 1000").count() == 0


def test_a_patient_added_while_windows_run_is_scored(spark, tmp_path):
    db = Database(spark, f"jdbc:derby:{tmp_path}/ward;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    db.run('CREATE TABLE patients ("patient_id" VARCHAR(8) PRIMARY KEY)', "INSERT INTO patients VALUES ('P001')")
    schema = "key binary, value binary, topic string, partition int, offset long"

    def put(n, pid):
        when = (START + dt.timedelta(minutes=n)).strftime("%Y-%m-%dT%H:%M:%SZ")
        body = json.dumps(GOOD | {"event_id": f"e{n}", "patient_id": pid, "timestamp": when, "produced_at": when}).encode()
        spark.createDataFrame([(b"", body, "vitals.raw", 0, n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(0, "P001")
    put(1, "P002")
    raw = jobs.source(spark, "parquet", schema, str(tmp_path / "in"))
    query = jobs.start(jobs.windowed(raw, db.read("patients")), "windows", jobs.write_log(str(tmp_path / "out")), str(tmp_path / "ckpt"), "update", {"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        db.run("INSERT INTO patients VALUES ('P002')")
        put(2, "P002")
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["patient_id"], r["n_readings"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("P001", 1), ("P002", 1)}


def test_counters_and_gauges(spark):
    day = 86_400
    values = [("a", 0, 5), ("a", 60, 9), ("a", 120, 2), ("a", 300, 3), ("a", 3 * day, 10), ("a", 3 * day + 60, 11), ("b", 60, 100)]
    df = spark.createDataFrame(values, "k string, t long, v long")
    got = {(r["k"], r["t"]): (r["increase"], r["rate"]) for r in monitors.increase(df, "k", "v", 300).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", 0): 0, ("a", 60): 4, ("a", 120): 6, ("a", 300): 7, ("a", 3 * day): 7, ("a", 3 * day + 60): 8, ("b", 60): 0}
    assert got["a", 300][1] == pytest.approx(7 / 300)
    changes = {(r["k"], r["t"]): r["delta"] for r in monitors.delta(df, "k", "v", 300).collect()}
    assert changes == {("a", 0): 0, ("a", 60): 4, ("a", 120): -3, ("a", 300): -6, ("a", 3 * day): 0, ("a", 3 * day + 60): 1, ("b", 60): 0}


def test_runs_are_those_of_a_plain_scan(spark):
    rnd = random.Random(2)
    rows = [(k, t, rnd.random() < 0.6) for k in "ab" for t in sorted(rnd.sample(range(0, 6 * 86_400, 7_200), 50))]
    want = []
    for i, (k, t, f) in enumerate(rows):
        if i and rows[i - 1][0] == k and rows[i - 1][2] == f:
            want[-1][3] = t
        else:
            want.append([k, f, t, t])
    got = monitors.runs(spark.createDataFrame(rows, "k string, t long, f boolean"), "k", "t", "f").collect()
    assert sorted(map(list, got)) == sorted(want)


def test_alerts_are_evaluated_on_a_grid(spark):
    rows = [("q", 5, False), ("q", 20, True), ("q", 110, True), ("q", 130, False), ("q", 500, True), ("r", 0, True), ("r", 290, True)]
    shares = spark.createDataFrame(rows, "k string, t long, firing boolean")
    points = monitors.evaluated(shares, "k", "firing", 30, 100, 570)
    got = {r["t"]: (r["firing"], r["absent"]) for r in points.where("k = 'q'").collect()}
    assert [t for t, v in got.items() if v == (True, False)] == [30, 60, 90, 120, 510, 540, 570] and [t for t, v in got.items() if v == (None, True)] == list(range(240, 500, 30)) and sorted(got) == list(range(30, 571, 30))
    alerts = monitors.held_alerts(shares, "k", 60, 30, 570, 100)
    assert sorted(map(tuple, alerts.collect())) == [("q", 30, 90, 150), ("q", 510, 570, None), ("r", 0, 60, 120), ("r", 300, 360, 390)]
    progress = spark.createDataFrame([("w", dt.datetime(2026, 1, 1, 0, 0, s)) for s in (0, 5, 10)] + [("v", dt.datetime(2026, 1, 1, 0, 1))], "name string, at timestamp")
    start = int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert [tuple(r) for r in monitors.inactive_queries(progress, start + 75, 5, 30, 10).collect()] == [("w", start + 40, start + 50, None)]


def test_trailing_ranges_take_a_step_a_row(spark):
    rnd = random.Random(3)
    rows = [(k, t, rnd.choice([None, 0, 1, 5])) for k in ("a", None) for t in sorted(rnd.sample(range(-400, 2_000), 300))]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    for seconds in (0, 7, 299, 5_000):
        inside = {(k, t): [v for j, u, v in rows if j == k and t - seconds <= u <= t] for k, t, _ in rows}
        sums = monitors._trailing(df, "k", seconds, s="v")
        assert "RangeFrame, -" not in sums._jdf.queryExecution().toString()  # such a frame is added up anew for every row
        total = {k: sum(w) if (w := [x for x in v if x is not None]) else None for k, v in inside.items()}
        assert {(r["k"], r["t"]): r["s"] for r in sums.collect()} == total
        if seconds:
            changes = {(r["k"], r["t"]): r["delta"] for r in monitors.delta(df, "k", "v", seconds + 1).collect()}
            assert changes == {k: None if v[0] is None or v[-1] is None else v[-1] - v[0] for k, v in inside.items()}
