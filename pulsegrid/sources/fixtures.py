"""Telemetry tables derived from the given events and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.rules import LAB_CATALOGUE

TESTS = ("WBC", "CRP", "LACTATE", "CREATININE", "POTASSIUM", "HAEMOGLOBIN", "TROPONIN")
RANGE_TEXTS = ("4.0-11.0", "<5", "0.5-2.0", "45-104", "3.5-5.3", "115-180", "<14")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, dealt to all cores by a hash of ``by`` where its scan has fewer tasks than there are cores.

    A small table can be one row group, which one task reads; work on its rows is to be shared. A scan with a task or
    more a core isn't shuffled. A hash deals a lost task's rows anew as before.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def readings(spark: SparkSession, sf_dir: str, patients: int = 20) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("event_time"), (F.col("user_id") % patients).alias("p"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    day = F.datediff("event_time", F.lit("2024-01-01").cast("date")).cast("long")
    e = e.withColumn("sv", F.when(F.col("p") % 4 == 0, (day * 3 + F.col("p")) % 10).otherwise(0))
    return e.select(
        "event_id",
        F.concat(F.lit("P"), F.lpad((F.col("p") + 1).cast("string"), 3, "0")).alias("patient_id"),
        F.expr("double(60 + (event_id * 7 + k) % 25 + 6 * sv)").alias("heart_rate"),
        F.expr("double(99 - (event_id * 3 + k) % 4 - sv)").alias("spo2"),
        F.expr("double(115 + (event_id * 5 + k) % 20 - 4 * sv)").alias("systolic_bp"),
        F.expr("double(55 + (event_id * 11 + k) % 15)").alias("diastolic_bp"),
        F.expr("double(362 + (event_id * 13 + k) % 10 + 3 * sv) / double(10)").alias("temperature"),
        "event_time",
        F.expr("event_time + make_dt_interval(0, 0, 0, k)").alias("produced_at"),
    )


READINGS_SQL = """
ev as (select event_id, ts, user_id % 20 as p, cast(json_extract_string(props, '$.k') as bigint) as k, date_diff('day', timestamp '2024-01-01', ts) as dd from events),
evs as (select *, case when p % 4 = 0 then (dd * 3 + p) % 10 else 0 end as sv from ev),
readings as (
  select event_id, 'P' || lpad((p + 1)::varchar, 3, '0') as patient_id, (60 + (event_id * 7 + k) % 25 + 6 * sv)::double as heart_rate,
    (99 - (event_id * 3 + k) % 4 - sv)::double as spo2, (115 + (event_id * 5 + k) % 20 - 4 * sv)::double as systolic_bp,
    (55 + (event_id * 11 + k) % 15)::double as diastolic_bp, (362 + (event_id * 13 + k) % 10 + 3 * sv)::double / 10::double as temperature,
    ts as event_time, ts + to_seconds(k) as produced_at
  from evs)"""


def raw_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as JSON messages of which some are corrupted and some come twice."""
    r = spread(readings(spark, sf_dir), "event_id")
    fault = F.when(F.col("event_id") % 50 == 7, (F.col("event_id") / 50).cast("long") % 7)
    number = lambda c: F.col(c).cast("long").cast("string")
    tenths = F.round(F.col("temperature") * 10).cast("long")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rate = F.when(fault == 1, "").when(fault == 2, '"heart_rate":"N/A",').when(fault == 3, '"heart_rate":400,').otherwise(F.concat(F.lit('"heart_rate":'), number("heart_rate"), F.lit(",")))
    swap = F.coalesce(fault == 4, F.lit(False))
    text = F.concat(
        F.lit('{"schema_version":1,"event_id":"'), F.col("event_id").cast("string"), F.lit('","patient_id":"'), F.when((fault == 6) & ((F.col("event_id") / 350).cast("long") % 2 == 1), "X95").when(fault == 6, "P950").otherwise(F.col("patient_id")), F.lit('",'), rate,
        F.lit('"spo2":'), number("spo2"), F.lit(',"systolic_bp":'), F.when(swap, number("diastolic_bp")).otherwise(number("systolic_bp")),
        F.lit(',"diastolic_bp":'), F.when(swap, number("systolic_bp")).otherwise(number("diastolic_bp")),
        F.lit(',"temperature":'), F.concat(F.expr("cast(round(temperature * 10) as bigint) div 10").cast("string"), F.lit("."), (tenths % 10).cast("string")),
        F.lit(',"timestamp":"'), F.when(fault == 5, "yesterday").otherwise(stamp("event_time")), F.lit('","produced_at":"'), stamp("produced_at"), F.lit('"}'),
    )
    text = F.when(fault == 0, F.substring(text, 1, 20)).otherwise(text)
    once = r.select(F.encode("patient_id", "UTF-8").alias("key"), F.encode(text, "UTF-8").alias("value"), F.lit("vitals.raw").alias("topic"), (F.col("event_id") % 6).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    return once.unionByName(once.where(F.col("offset") % 100 == 3).withColumn("offset", F.col("offset") + 10_000_000))


RAW_VITALS_SQL = READINGS_SQL + """,
faulty as (select *, case when event_id % 50 = 7 then (event_id // 50) % 7 end as fault, round(temperature * 10)::bigint as t10 from readings),
texts as (
  select event_id, '{"schema_version":1,"event_id":"' || event_id || '","patient_id":"' || (case when fault = 6 and (event_id // 350) % 2 = 1 then 'X95' when fault = 6 then 'P950' else patient_id end) || '",'
    || (case when fault = 1 then '' when fault = 2 then '"heart_rate":"N/A",' when fault = 3 then '"heart_rate":400,' else '"heart_rate":' || heart_rate::bigint || ',' end)
    || '"spo2":' || spo2::bigint || ',"systolic_bp":' || (case when fault = 4 then diastolic_bp else systolic_bp end)::bigint || ',"diastolic_bp":'
    || (case when fault = 4 then systolic_bp else diastolic_bp end)::bigint || ',"temperature":' || (t10 // 10) || '.' || (t10 % 10)
    || ',"timestamp":"' || (case when fault = 5 then 'yesterday' else strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') end) || '","produced_at":"' || strftime(produced_at, '%Y-%m-%dT%H:%M:%SZ') || '"}' as full_text, fault
  from faulty),
once as (select case when fault = 0 then substr(full_text, 1, 20) else full_text end as value, event_id % 6 as part, event_id as ofs from texts),
raw_vitals as (select * from once union all select value, part, ofs + 10000000 from once where ofs % 100 = 3)"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("p")).distinct()
    return p.select(F.concat(F.lit("P"), F.lpad((F.col("p") + 1).cast("string"), 3, "0")).alias("patient_id"), F.concat(F.lit("B"), F.lpad((F.col("p") + 1).cast("string"), 2, "0")).alias("bed"), (F.col("p") * 2 + 40).cast("int").alias("age"), F.when(F.col("p") % 4 == 0, "deteriorating").otherwise("stable").alias("scenario"), (F.col("p") != 19).alias("active"))


ROSTER_SQL = """
roster as (
  select 'P' || lpad((p + 1)::varchar, 3, '0') as patient_id, 'B' || lpad((p + 1)::varchar, 2, '0') as bed, (40 + p * 2)::int as age,
    case when p % 4 = 0 then 'deteriorating' else 'stable' end as scenario, p <> 19 as active
  from (select distinct user_id % 20 as p from events))"""


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").alias("q"))
    which = ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int")
    value = F.expr("array(2 + q / 4, 3 * q, q / 10, 50 + 3 * q, (25 + q) / 10, 60 + 2 * q, q / 2)")
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, ((l_orderkey * 37) % 720) * 60 + l_linenumber, 0)")
    out = l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), F.concat(F.lit("P"), F.lpad((F.col("l_suppkey") % 20 + 1).cast("string"), 3, "0")).alias("patient_id"),
        F.get(F.array(*map(F.lit, TESTS)), which).alias("test_type"), F.get(value, which).alias("result_value"), F.get(F.array(*map(F.lit, RANGE_TEXTS)), which).alias("reference_range"), at.alias("collected_at"),
    )
    unit = F.create_map(*[F.lit(x) for t, (u, *_) in LAB_CATALOGUE.items() for x in (t, u)])
    return out.withColumns({"file_day": F.to_date("collected_at"), "unit": unit[F.col("test_type")]})


LABS_SQL = """
li as (select l_orderkey, l_suppkey, l_linenumber::bigint as n, l_quantity::double as q, ((l_partkey + l_linenumber) % 7)::int as w from lineitem),
labs as (
  select l_orderkey || '-' || n as sample_id, 'P' || lpad((l_suppkey % 20 + 1)::varchar, 3, '0') as patient_id,
    ['WBC', 'CRP', 'LACTATE', 'CREATININE', 'POTASSIUM', 'HAEMOGLOBIN', 'TROPONIN'][w + 1] as test_type,
    [2 + q / 4, 3 * q, q / 10, 50 + 3 * q, (25 + q) / 10, 60 + 2 * q, q / 2][w + 1] as result_value,
    ['4.0-11.0', '<5', '0.5-2.0', '45-104', '3.5-5.3', '115-180', '<14'][w + 1] as reference_range,
    timestamp '2024-01-01' + to_minutes(((l_orderkey * 37) % 720) * 60 + n) as collected_at,
    (timestamp '2024-01-01' + to_minutes(((l_orderkey * 37) % 720) * 60 + n))::date as file_day
  from li)"""
