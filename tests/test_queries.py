"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pulsegrid.plans import queries
from pulsegrid.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("Int") or df[c].dtype.kind == "i":  # whole numbers with nulls come as floats from one side
            df[c] = df[c].astype("float64")
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
    return df.astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(list(df.columns)).values.tolist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(con.sql(ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["parse_labs", "lab_csv_rejects", "lab_events", "parse_vitals"])
def test_messages_are_not_shuffled_to_the_patients(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # events of any size
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_report_combines_labs_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_labs", lambda s, d, f=queries._labs: asked.append(d) or f(s, d))
    plan = QUERIES["report_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and "l_orderkey" not in plan  # what is read again is the checkpoint
