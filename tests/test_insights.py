from pyspark.sql import functions as F

from skyroll.operators import insights, rankings
from skyroll.operators.checks import readiness

AIRLINE_SCHEMA = ("AIRLINE string, flights bigint, carrier_delay double, weather_delay double, "
                  "nas_delay double, security_delay double, late_delay double, "
                  "arrival_delay double, departure_delay double, cancelled double, diverted double")
SUMMARY_SCHEMA = ("total_flights bigint, avg_arrival_delay double, avg_departure_delay double, "
                  "avg_carrier_delay double, avg_weather_delay double, avg_nas_delay double, "
                  "avg_security_delay double, avg_late_delay double, cancelled_rate double, "
                  "diverted_rate double, avg_distance double, min_year int, max_year int")


def _airlines(spark, data):
    full = [(a, f, None, None, None, None, None, arr, None, c, None) for a, f, arr, c in data]
    return spark.createDataFrame(full, AIRLINE_SCHEMA)


def _summary(spark, causes, cancelled=0.02):
    return spark.createDataFrame(
        [(100, 5.0, 4.0, *causes, cancelled, 0.002, 800.0, 2015, 2021)], SUMMARY_SCHEMA)


def test_worst_carrier_needs_two_eligible(spark):
    one = _airlines(spark, [("AA", 200, 9.0, 0.01), ("BB", 50, 20.0, 0.02)])
    assert rankings.best_carrier(one, 100).collect()[0].AIRLINE == "AA"
    assert rankings.worst_carrier(one, 100).count() == 0
    two = _airlines(spark, [("AA", 200, 9.0, 0.01), ("BB", 150, None, 0.02)])
    # a NULL mean ranks as 0
    assert rankings.best_carrier(two, 100).collect()[0].AIRLINE == "BB"
    assert rankings.worst_carrier(two, 100).collect()[0].AIRLINE == "AA"


def test_cancellation_intensity_and_zero_max(spark):
    df = _airlines(spark, [("AA", 10, 1.0, 0.02), ("BB", 10, 1.0, 0.01)])
    got = {r.AIRLINE: r.intensity for r in rankings.cancellation_ranking(df).collect()}
    assert got == {"AA": 1.0, "BB": 0.5}
    zero = _airlines(spark, [("AA", 10, 1.0, 0.0)])
    assert rankings.cancellation_ranking(zero).collect()[0].intensity is None


def test_cause_shares_and_dominant(spark):
    s = _summary(spark, (3.0, 1.0, 3.0, 0.0, 2.0))
    shares = {r.cause: r.share for r in insights.cause_shares(s).collect()}
    assert set(shares) == {"Carrier", "Weather", "NAS", "Late Aircraft"}   # zero left out
    assert abs(sum(shares.values()) - 1.0) < 1e-12
    top = insights.dominant_cause(s).collect()[0]
    assert top.cause == "Carrier"          # tie with NAS -> listed order
    none = _summary(spark, (0.0, 0.0, 0.0, 0.0, None))
    assert insights.dominant_cause(none).count() == 0


def test_peak_month_ties_and_range_filter(spark):
    monthly = spark.createDataFrame(
        [(2015, 1, 10.0), (2016, 1, 20.0), (2015, 7, 15.0), (2015, 13, 99.0), (2015, 0, 99.0)],
        "YEAR int, MONTH int, arrival_delay double")
    season = {r.MONTH: r.avg_arrival_delay for r in insights.seasonality(monthly).collect()}
    assert season == {1: 15.0, 7: 15.0}
    peak = insights.peak_month(monthly).collect()[0]
    assert (peak.MONTH, peak.month_name, peak.delta_pct) == (1, "January", 0.0)
    empty = monthly.filter(F.lit(False))
    assert insights.peak_month(empty).count() == 0


def test_cancellation_grades(spark):
    for rate, grade in [(0.01, "positive"), (0.02, "info"), (0.03, "warning")]:
        got = insights.cancellation_health(_summary(spark, (1.0,) * 5, rate)).collect()[0]
        assert got.grade == grade and got.note


def test_insights_drop_rows_with_empty_inputs(spark):
    airlines = _airlines(spark, [("AA", 10, 1.0, 0.0)])        # nobody above the floor
    airports = spark.createDataFrame([], "ORIGIN_AIRPORT string, flights bigint, "
                                         "arrival_delay double")
    monthly = spark.createDataFrame([], "YEAR int, MONTH int, arrival_delay double")
    s = _summary(spark, (1.0, 0.0, 0.0, 0.0, 0.0))
    got = [r.ord for r in insights.insights(airlines, airports, monthly, s, 100).collect()]
    assert sorted(got) == [5, 6]


def test_kpi_rows_and_month_labels(spark):
    kpis = insights.kpi_rows(_summary(spark, (1.0,) * 5, 0.0123)).collect()
    assert [k.ord for k in kpis] == [1, 2, 3, 4, 5, 6]
    assert kpis[3].value == 1.23 and kpis[0].sub_value == 2015.0
    m = spark.createDataFrame([(2015, 2, 1.0, 10), (2015, None, 1.0, 10)],
                              "YEAR int, MONTH int, arrival_delay double, flights bigint")
    for c in ["departure_delay", "carrier_delay", "weather_delay"]:
        m = m.withColumn(c, F.lit(None).cast("double"))
    labels = sorted(r.label for r in insights.monthly_trends(m).collect())
    assert labels == ["Feb 2015", "Jan 2015"]


def test_readiness_gate(spark):
    a = spark.range(3)
    empty = spark.range(0)
    got = {r.output: (r.ready, r.all_ready)
           for r in readiness({"airlines": a, "airports": empty}).collect()}
    assert got == {"airlines": (True, False), "airports": (False, False)}


def test_one_pass_insights_equal_the_parts(spark):
    from skyroll.operators.aggregates import grain_table
    from skyroll.operators.insights import insights, insights_from_grains
    from skyroll.plans.dashboard import served_from_flights
    from skyroll.registry import flights
    from support import SF_SMALL, rows

    fact = flights(spark, SF_SMALL).cache()
    table = grain_table(fact)
    v = served_from_flights(fact, materialise=False)
    for least in (0, 340, 10**9):
        want = insights(v.airlines, v.airports, v.monthly, v.summary, least)
        got = insights_from_grains(table, least)
        assert got.columns == want.columns and rows(got) == rows(want)
    none = insights_from_grains(grain_table(fact.limit(0)), 0)
    assert none.count() == 0
    plan = insights_from_grains(table, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    fact.unpersist()
