"""Property tests: the rollup and grouping-sets forms equal the direct form."""

import pytest
from pyspark.sql import functions as F

from skyroll.operators import aggregates as agg
from skyroll.registry import flights

from support import SF_SMALL, rows


@pytest.fixture(scope="module")
def fact(spark):
    return flights(spark, SF_SMALL).cache()


@pytest.mark.parametrize("direct, rollup, grains", [
    (agg.by_airline, agg.airline_from_rollup, agg.airline_from_grains),
    (agg.by_airport_top, agg.airport_top_from_rollup, agg.airport_top_from_grains),
    (agg.by_month, agg.month_from_rollup, agg.month_from_grains),
    (agg.summary, agg.summary_from_rollup, agg.summary_from_grains),
])
def test_three_forms_agree(fact, direct, rollup, grains):
    d = direct(fact)
    r = rollup(agg.flight_rollup(fact))
    g = grains(agg.grain_table(fact))
    assert d.dtypes == r.dtypes == g.dtypes
    assert rows(d) == rows(r) == rows(g)


def test_carrier_flights_add_up_to_total(fact):
    total = agg.summary(fact).collect()[0].total_flights
    assert agg.by_airline(fact).agg(F.sum("flights")).collect()[0][0] == total
    assert total == fact.count()


def test_null_carrier_is_its_own_group(fact):
    nulls = fact.filter(F.col("AIRLINE").isNull()).count()
    got = agg.by_airline(fact).filter(F.col("AIRLINE").isNull()).collect()
    assert nulls > 0 and got[0].flights == nulls


def test_cause_means_skip_nulls(spark):
    df = spark.createDataFrame(
        [("AA", 30.0, 20.0), ("AA", None, 5.0), ("AA", None, None)],
        "AIRLINE string, ARRIVAL_DELAY double, CARRIER_DELAY double")
    full = df
    for c in ["DEPARTURE_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY",
              "LATE_AIRCRAFT_DELAY", "CANCELLED", "DIVERTED"]:
        full = full.withColumn(c, F.lit(None).cast("double"))
    r = agg.by_airline(full).collect()[0]
    assert r.flights == 3 and r.arrival_delay == 30.0 and r.carrier_delay == 12.5
    assert r.cancelled is None


def test_rounding_is_half_up(spark):
    # mean 1.005 -> 1.01 (HALF_UP on the decimal form), 2.675 -> 2.68
    df = spark.createDataFrame([(1.005,), (2.675,)], "x double")
    got = [r[0] for r in df.select(F.round("x", 2)).collect()]
    assert got == [1.01, 2.68]


def test_top_airports_break_ties_by_key(spark):
    data = [("B",), ("A",), ("C",), ("C",)]
    df = spark.createDataFrame(data, "ORIGIN_AIRPORT string")
    for c in ["ARRIVAL_DELAY", "DEPARTURE_DELAY", "CARRIER_DELAY", "WEATHER_DELAY",
              "NAS_DELAY", "CANCELLED", "DIVERTED"]:
        df = df.withColumn(c, F.lit(1.0))
    top = [r.ORIGIN_AIRPORT for r in agg.by_airport_top(df, 2).collect()]
    assert top == ["C", "A"]


def test_merge_rollups_is_additive(fact):
    a, b = fact.randomSplit([0.5, 0.5], seed=7)
    merged = agg.merge_rollups(agg.flight_rollup(a), agg.flight_rollup(b))
    assert rows(agg.airline_from_rollup(merged)) == rows(agg.by_airline(fact))
