"""Plan-shape guards for the properties the design relies on at scale."""

import re
import pytest

import __spark_entry__ as entry
from skyroll.operators.aggregates import grain_table
from skyroll.plans.run import labelled_flights
from skyroll.registry import raw_sources

from support import SF_SMALL

# Queries whose plans are pure (building them runs no job with side effects).
PURE = ["by_airline", "by_airport_top50", "by_month", "summary", "unified_flights",
        "null_airline_check", "rollup_by_airline", "all_grains", "grains_summary",
        "keyed_items_monthly", "keyed_upsert", "holidays_normalised", "holiday_records",
        "standardise_2015", "source_profile", "run_totals"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_python_udf_cartesian_or_forced_broadcast(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


def test_grain_job_pre_aggregates_before_its_shuffle(spark):
    fl = labelled_flights(raw_sources(spark, SF_SMALL))
    plan = _plan(grain_table(fl, extra_sets={"source": ["source"]}))
    lines = [ln.strip(" :+-") for ln in plan.splitlines()]
    agg_exchange = [i for i, ln in enumerate(lines)
                    if ln.startswith("Exchange hashpartitioning(AIRLINE")]
    assert len(agg_exchange) == 1                      # one shuffle for all outputs
    below = lines[agg_exchange[0] + 1]
    assert below.startswith("HashAggregate") and "partial_avg" in below
    assert any(ln.startswith("Expand") for ln in lines)


def test_scan_reads_only_needed_columns_with_pushed_filters(spark):
    plan = _plan(entry.queries()["by_airline"](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans
    for s in scans:
        assert "l_comment" not in s and "l_returnflag" not in s
        assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", s)


def test_top_k_is_bounded(spark):
    from skyroll.operators.aggregates import by_airport_top
    from skyroll.registry import flights
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(by_airport_top(flights(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "TakeOrderedAndProject(limit=50" in plan
