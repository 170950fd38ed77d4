import math

import pytest
from pyspark.sql import functions as F

from skyroll.functions.casts import to_double, to_int
from skyroll.operators.standardise import MissingColumnError, flights_from_sources, standardise
from skyroll.schemas import FLIGHTS_SCHEMA, source_specs
from skyroll.sources.raw import read_raw_csv

DIRTY = ["", '""', " ", "NA", "NaN", "x", "-3", "1.0", "1.7", "99999999999", " 5 ", None]


def test_double_cast_rules(spark):
    df = spark.createDataFrame([(v,) for v in DIRTY], "v string")
    got = {r.v: r.d for r in df.select("v", to_double(F.col("v")).alias("d")).collect()}
    assert got[""] is None and got['""'] is None and got[" "] is None
    assert got["NA"] is None and got["x"] is None and got[None] is None
    assert got["NaN"] is None          # NaN would poison the means
    assert got["-3"] == -3.0 and got["1.7"] == 1.7 and got[" 5 "] == 5.0
    assert got["99999999999"] == 99999999999.0


def test_int_cast_rules(spark):
    df = spark.createDataFrame([(v,) for v in DIRTY], "v string")
    got = {r.v: r.i for r in df.select("v", to_int(F.col("v")).alias("i")).collect()}
    assert got["1.0"] == 1 and got["1.7"] == 1      # lenient cast truncates
    assert got["99999999999"] is None               # out of int range
    assert got["-3"] == -3 and got[" 5 "] == 5
    assert got["NA"] is None and got["NaN"] is None and got[" "] is None


def _raw_2015(spark, rows):
    spec = source_specs()[0]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in spec.source_columns))


def test_standardise_2015_maps_renamed_causes(spark):
    spec = source_specs()[0]
    row = ["2015", "1", "2", "5", "AA", "JFK", "LAX", "20", "10", "7", "1", "3", "0", "9",
           "0", "0", "2475"]
    out = standardise(_raw_2015(spark, [row]), spec).collect()[0]
    assert out.CARRIER_DELAY == 7.0   # from AIRLINE_DELAY
    assert out.NAS_DELAY == 3.0       # from AIR_SYSTEM_DELAY
    assert out.YEAR == 2015 and out.DISTANCE == 2475.0


def test_standardise_schema_and_union(spark):
    specs = source_specs()
    a = _raw_2015(spark, [["2015"] + ["1"] * 16])
    b = spark.createDataFrame([["2019"] + ["2"] * 16],
                              ", ".join(f"`{c}` string" for c in specs[1].source_columns))
    fact = flights_from_sources({"2015": a, "2018_2024": b})
    assert fact.schema == FLIGHTS_SCHEMA
    assert sorted(r.YEAR for r in fact.collect()) == [2015, 2019]


def test_unmapped_columns_dropped_and_missing_column_raises(spark):
    spec = source_specs()[0]
    df = _raw_2015(spark, [["2015"] + ["1"] * 16]).withColumn("EXTRA", F.lit("z"))
    assert "EXTRA" not in standardise(df, spec).columns
    with pytest.raises(MissingColumnError):
        standardise(df.drop("DISTANCE"), spec)


def test_same_name_in_two_cases_prefers_exact_match(spark):
    spec = source_specs()[0]
    cols = spec.source_columns + ["airline"]
    vals = ["2015"] + ["1"] * 3 + ["UPPER"] + ["1"] * 12 + ["lower"]
    df = spark.createDataFrame([vals], ", ".join(f"`{c}` string" for c in cols))
    out = standardise(df, spec).collect()[0]
    assert out.AIRLINE == "UPPER"


def test_csv_scan_reads_strings_with_header(spark, tmp_dir):
    path = f"{tmp_dir}/f.csv"
    spec = source_specs()[1]
    with open(path, "w") as f:
        f.write(",".join(spec.source_columns) + "\n")
        f.write("2019,3,4,1,DL,ATL,BOS,NA,,,,,,,0,0,946\n")
        f.write("2019,3,4,1,,ATL,BOS,12,5,,,,,,1.0,0,946\n")
    raw = read_raw_csv(spark, path)
    assert all(t == "string" for _, t in raw.dtypes)
    out = sorted(standardise(raw, spec).collect(), key=lambda r: r.CANCELLED)
    assert out[0].ARRIVAL_DELAY is None and out[0].AIRLINE == "DL"
    assert out[1].AIRLINE is None and out[1].CANCELLED == 1.0
    assert not any(isinstance(v, float) and math.isnan(v) for r in out for v in r)
