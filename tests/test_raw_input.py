"""Raw input: columns are bound by header, and nothing is lost in silence."""

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from skyroll.functions.casts import typed_sql
from skyroll.schemas import source_specs
from skyroll.sources.fixture import fixture_sources
from skyroll.sources.holidays import read_holiday_arrays
from skyroll.sources.json_lines import read_json_output
from skyroll.sources.raw import read_raw_csv
from skyroll.streaming.incremental import flight_stream


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_files_with_another_header_are_rejected(spark, tmp_path):
    put(tmp_path / "d", "a.csv", "AIRLINE,ORIGIN_AIRPORT,X", "AA,JFK,1", "BB,LAX,2")
    assert {r.AIRLINE for r in read_raw_csv(spark, str(tmp_path / "d")).collect()} == {"AA", "BB"}
    put(tmp_path / "d", "b.csv", "X,AIRLINE,ORIGIN_AIRPORT", "3,CC,SFO")
    with pytest.raises(Exception, match="(?i)header"):
        read_raw_csv(spark, str(tmp_path / "d")).collect()


def test_stream_binds_by_header(spark, tmp_path):
    spec = {s.label: s for s in source_specs()}["2015"]
    cols = ["EXTRA", *reversed(spec.source_columns)]
    values = {c: "1" for c in cols} | {"AIRLINE": "AA", "ORIGIN_AIRPORT": "JFK", "EXTRA": "zz"}
    put(tmp_path / "in", "a.csv", ",".join(cols), ",".join(values[c] for c in cols))
    query = (flight_stream(spark, {"2015": str(tmp_path / "in")}).writeStream
             .format("memory").queryName("bound_by_header").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.awaitTermination()
    row = spark.table("bound_by_header").collect()[0]
    assert (row.AIRLINE, row.ORIGIN_AIRPORT) == ("AA", "JFK")


def test_null_ship_dates_stay(spark, tmp_path):
    lineitem = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    (lineitem.withColumn("l_shipdate", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_shipdate")))
     .write.parquet(str(tmp_path / "lineitem.parquet")))
    got = fixture_sources(spark, str(tmp_path))
    assert sum(df.count() for df in got.values()) == lineitem.count()


def test_broken_json_fails(spark, tmp_path):
    put(tmp_path / "j", "part-0.json", '{"AIRLINE": "AA"}', '{"AIRLINE": "B')
    schema = spark.range(0).select(F.lit("x").alias("AIRLINE")).schema
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json_output(spark, str(tmp_path / "j"), schema).collect()


def test_broken_holiday_year_fails(spark, tmp_path):
    put(tmp_path / "h", "2019.json", '[{"date": "2019-01-01", "name": "N"}]')
    assert read_holiday_arrays(spark, str(tmp_path / "h")).count() == 1
    put(tmp_path / "h", "2020.json", '[{"date": "2020-01-01", "na')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_holiday_arrays(spark, str(tmp_path / "h")).collect()


def test_typed_sql_on_dirty_numbers(spark):
    rows = [("1.7",), ("NaN",), ("Infinity",), ("-Infinity",), ("",), ("x",), (None,), (" 3 ",)]
    got = spark.createDataFrame(rows, "v string").selectExpr(
        typed_sql("v", "double") + " AS d", typed_sql("v", "int") + " AS i").collect()
    assert [r.d for r in got] == [1.7, None, None, None, None, None, None, 3.0]
    assert [r.i for r in got] == [1, None, None, None, None, None, None, 3]
