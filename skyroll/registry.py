"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query starts from the driver's tables: raw flights are generated from
``lineitem`` (sources.fixture), holidays from ``orders`` (sources.holidays),
so each query's work grows with the tables. The matching DuckDB SQL for the
correctness check lives in ``skyroll.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.operators import aggregates as agg
from skyroll.operators import checks, insights, rankings
from skyroll.operators.setops import read_row_texts, union_row_headers
from skyroll.operators.standardise import flights_from_sources, standardise
from skyroll.plans.dashboard import DIRECT, outputs_from_grains, served_output
from skyroll.plans.replay import output_schemas, replay
from skyroll.plans.run import run
from skyroll.registry_input import QUERIES as INPUT_QUERIES
from skyroll.schemas import KEYED_OUTPUTS, source_specs
from skyroll.session import checkpointed, scratch_path
from skyroll.sinks.csv_out import write_csv
from skyroll.sinks.json_out import write_json_output
from skyroll.sinks.keyed import KeyedStore, keyed_items, merge_items
from skyroll.sources import holidays as hol
from skyroll.sources.fixture import fixture_sources
from skyroll.sources.headers import headers, list_files
from skyroll.sources.raw import read_sources
from skyroll.sources.json_lines import read_json_output
from skyroll.sources.served import load_dataset
from skyroll.streaming.incremental import start_incremental_run

# Eligibility floor for the best / worst carrier insight at the test scale:
# carriers have 3,328-3,601 flights at sf0.01, so both sides occur.
MIN_FLIGHTS = 3400
# Items of a page; the airport store has 50 or more.
PAGE_ITEMS = 8

Query = Callable[[SparkSession, str], DataFrame]


def _spec(label: str):
    return {s.label: s for s in source_specs()}[label]


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture_sources(spark, sf_dir)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights_from_sources(raw_sources(spark, sf_dir))


def one(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return served_output(flights(spark, sf_dir), name)


def _outputs(spark: SparkSession, sf_dir: str):
    """The four outputs as a run writes them, from one checkpointed grain table."""
    return outputs_from_grains(checkpointed(agg.grain_table(flights(spark, sf_dir))))


def _keyed(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return keyed_items(DIRECT[name](flights(spark, sf_dir)), KEYED_OUTPUTS[name][1])
    return q


def _upsert_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An earlier run over the 2015 layout only, then a run over both."""
    raw = raw_sources(spark, sf_dir)
    early = agg.by_airport_top(standardise(raw["2015"], _spec("2015")))
    full = agg.by_airport_top(flights_from_sources(raw))
    return keyed_items(early, "ORIGIN_AIRPORT"), keyed_items(full, "ORIGIN_AIRPORT")


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _upsert_batches(spark, sf_dir)
    return merge_items(old, new)


def keyed_upsert_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert across a schema change: the earlier items predate the
    ``diverted`` column; merged rows are a header union (SET2), so items
    written before the change read it as NULL."""
    old, new = _upsert_batches(spark, sf_dir)
    return merge_items(old.drop("diverted"), new)


def keyed_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _upsert_batches(spark, sf_dir)
    store = KeyedStore(spark, scratch_path(spark, "store"), "flight_airports")
    store.upsert(old)
    store.upsert(new)
    return store.read()


def keyed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of the store, read page by page."""
    old, new = _upsert_batches(spark, sf_dir)
    store = KeyedStore(spark, scratch_path(spark, "store"), "flight_airports")
    store.upsert(old)
    store.upsert(new)
    pages = [page.withColumn("page", F.lit(k)) for k, page in enumerate(store.pages(PAGE_ITEMS))]
    return reduce(lambda a, b: a.unionByName(b), pages)


def keyed_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch that writes every carrier month by month: the last write stays."""
    monthly = (flights(spark, sf_dir).groupBy("AIRLINE", "YEAR", "MONTH")
               .agg(F.count(F.lit(1)).alias("flights")).orderBy("YEAR", "MONTH"))
    store = KeyedStore(spark, scratch_path(spark, "store"), "flight_last_month")
    store.upsert(keyed_items(monthly, "AIRLINE"))
    return store.read()


def uneven_rows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON rows with differing keys to CSV and back, under the union of their keys;
    texts hold quotes, commas and line ends, and one value is nested."""
    cust = F.col("o_custkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_json(F.struct(
        F.col("o_orderkey").alias("order"),
        F.when(cust % 3 == 0, F.col("o_orderstatus")).alias("status"),
        F.when(cust % 4 == 0, F.concat(F.lit('said "'), F.col("o_orderpriority"),
                                       F.lit('",\nthen left'))).alias("the note"),
        F.when(cust % 5 == 0, F.array(F.lit("a,b"), F.col("o_orderstatus"))).alias("tags"),
        F.when(cust % 7 == 0, F.col("o_custkey") > 100).alias("large"))).alias("value"))
    root = scratch_path(spark, "uneven")
    rows.write.text(f"{root}/json")
    write_csv(union_row_headers(read_row_texts(spark, f"{root}/json")), f"{root}/csv",
              single_file=False)
    # every part has the header; one schema for all, read by name
    names = ["order", "status", "the note", "tags", "large"]
    return (spark.read.schema(", ".join(f"`{n}` string" for n in _csv_header(spark, f"{root}/csv")))
            .option("header", "true").option("multiLine", "true").option("escape", '"')
            .csv(f"{root}/csv").select(*[F.col(f"`{n}`") for n in names]))


def _csv_header(spark: SparkSession, folder: str) -> list[str]:
    (names,) = headers(spark, list_files(spark, folder))
    return list(names)


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    airlines = agg.by_airline(flights(spark, sf_dir))
    folder = scratch_path(spark, "json") + "/airlines"
    write_json_output(airlines, folder)
    return read_json_output(spark, folder, airlines.schema)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    airlines = agg.by_airline(flights(spark, sf_dir))
    folder = scratch_path(spark, "csv") + "/airlines"
    write_csv(airlines, folder)
    return (spark.read.schema(airlines.schema).option("header", "true")
            .option("escape", '"').csv(folder))


def _run_into_scratch(spark: SparkSession, sf_dir: str, with_store: bool):
    root = scratch_path(spark, "run")
    store_root = f"{root}/store" if with_store else None
    result = run(spark, raw_sources(spark, sf_dir), f"{root}/json", store_root)
    return root, result


def served_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, result = _run_into_scratch(spark, sf_dir, with_store=True)
    store = KeyedStore(spark, f"{root}/store", KEYED_OUTPUTS["airlines"][0])
    return load_dataset(spark, store, f"{root}/json/airlines", result.outputs.airlines.schema)


def served_read_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, result = _run_into_scratch(spark, sf_dir, with_store=False)
    store = KeyedStore(spark, f"{root}/store", KEYED_OUTPUTS["airlines"][0])
    return load_dataset(spark, store, f"{root}/json/airlines", result.outputs.airlines.schema)


def served_read_broken_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's newest snapshot can't be read: the JSON output is served."""
    root, result = _run_into_scratch(spark, sf_dir, with_store=True)
    table = KEYED_OUTPUTS["airlines"][0]
    store = KeyedStore(spark, f"{root}/store", table)
    spark.range(3).selectExpr("'no parquet' AS value").write.text(broken := store.snapshots.new_folder())
    store.snapshots.commit(broken, store.snapshots.next_version())
    return load_dataset(spark, store, f"{root}/json/airlines", result.outputs.airlines.schema)


def decimal_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per carrier inside an array, a struct and a map, as the store keeps them."""
    items = agg.by_airline(flights(spark, sf_dir)).select(
        "AIRLINE", F.array("carrier_delay", "weather_delay").alias("causes"),
        F.struct("arrival_delay", F.struct("cancelled").alias("rates")).alias("nested"),
        F.create_map(F.lit("dep"), F.col("departure_delay") / 3).alias("by_name"))
    kept = keyed_items(items, "AIRLINE")
    return kept.select("item_key", F.col("causes")[0].alias("first"), F.col("causes")[1].alias("second"),
                       F.col("nested.arrival_delay").alias("arrival"),
                       F.col("nested.rates.cancelled").alias("cancelled"),
                       F.col("by_name")["dep"].alias("third_of_departure"))


def run_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_into_scratch(spark, sf_dir, with_store=False)[1].source_profile


def run_null_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_into_scratch(spark, sf_dir, with_store=False)[1].null_airline


def replay_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _run_into_scratch(spark, sf_dir, with_store=False)
    return replay(spark, f"{root}/json", f"{root}/replayed")


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hol.holiday_payloads(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def holidays_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "holidays")
    hol.archive_holidays(_payload(spark, sf_dir), root)
    return hol.holiday_store(hol.read_holiday_archive(spark, root))


def _landed_csv(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Both layouts as CSV folders whose files have the columns in another order
    than the mapping, and more of them, as raw flight files do."""
    root, landing = scratch_path(spark, "landed"), {}
    for label, df in raw_sources(spark, sf_dir).items():
        landing[label] = f"{root}/{label}"
        (df.select(F.lit("N1").alias("TAIL_MARK"), *reversed(df.columns), F.lit("7").alias("TAXI_MARK"))
         .write.option("header", "true").csv(landing[label]))
    return landing


def csv_sources_by_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_sources(spark, _landed_csv(spark, sf_dir))
    return agg.by_airline(flights_from_sources(raw))


def csv_sources_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.source_profile(read_sources(spark, _landed_csv(spark, sf_dir)))


def _run_stream(spark: SparkSession, landing: dict[str, str]) -> str:
    root = scratch_path(spark, "stream")
    query = start_incremental_run(spark, landing, f"{root}/out", f"{root}/store",
                                  max_files_per_trigger=4)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"streaming run failed: {query.exception()}")
    return root


def streaming_csv_by_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _run_stream(spark, _landed_csv(spark, sf_dir))
    return read_json_output(spark, f"{root}/out/airlines", output_schemas(spark)["airlines"])


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Land the raw layouts as CSV files, then process them incrementally
    (several micro-batches) with the streaming run; returns its root."""
    root = scratch_path(spark, "stream")
    landing = {}
    for label, df in raw_sources(spark, sf_dir).items():
        landing[label] = f"{root}/landing/{label}"
        df.write.option("header", "true").csv(landing[label])
    return _run_stream(spark, landing)


def _streamed_output(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _streamed(spark, sf_dir)
        return read_json_output(spark, f"{root}/out/{name}", output_schemas(spark)[name])
    return q


def streaming_keyed_airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed carrier items after the streaming run. Every micro-batch upserts
    every carrier, so the store ends equal to the final carrier output. (The
    airport store would also keep airports that were in the top 50 of an
    earlier micro-batch only - items are never deleted.)"""
    root = _streamed(spark, sf_dir)
    return KeyedStore(spark, f"{root}/store", KEYED_OUTPUTS["airlines"][0]).read()


QUERIES: dict[str, Query] = {
    # step 1: sources, standardise, union, carriers
    "standardise_2015": lambda s, d: standardise(raw_sources(s, d)["2015"], _spec("2015")),
    "standardise_2018_2024": lambda s, d: standardise(raw_sources(s, d)["2018_2024"],
                                                      _spec("2018_2024")),
    "unified_flights": flights,
    "by_airline": lambda s, d: agg.by_airline(flights(s, d)),
    # step 2: the other aggregates and checks
    "by_airport_top50": lambda s, d: agg.by_airport_top(flights(s, d)),
    "by_month": lambda s, d: agg.by_month(flights(s, d)),
    "summary": lambda s, d: agg.summary(flights(s, d)),
    "null_airline_check": lambda s, d: checks.null_airline_check(flights(s, d)),
    "source_profile": lambda s, d: checks.source_profile(raw_sources(s, d)),
    "run_totals": lambda s, d: (lambda o: checks.run_totals(o.summary, o.airlines, o.airports,
                                                            o.monthly))(_outputs(s, d)),
    # step 3: rankings over the served aggregates
    "airport_traffic_top15": lambda s, d: rankings.airport_traffic(one(s, d, "airports")),
    "airport_delay_matrix": lambda s, d: rankings.airport_delay_matrix(one(s, d, "airports")),
    "airport_delay_matrix_long": lambda s, d: rankings.airport_delay_matrix_long(
        one(s, d, "airports")),
    "delay_breakdown_top12": lambda s, d: rankings.delay_breakdown(one(s, d, "airlines")),
    "cancellation_top15": lambda s, d: rankings.cancellation_ranking(one(s, d, "airlines")),
    "airline_table_sorted": lambda s, d: rankings.airline_table_sorted(one(s, d, "airlines")),
    "airline_table_by_arrival_asc": lambda s, d: rankings.airline_table_sorted(
        one(s, d, "airlines"), "arrival_delay", descending=False),
    "airline_severity": lambda s, d: rankings.airline_severity(one(s, d, "airlines")),
    "monthly_trends": lambda s, d: insights.monthly_trends(one(s, d, "monthly")),
    "delay_scatter": lambda s, d: rankings.delay_scatter(one(s, d, "airports")),
    # step 4: insights
    "seasonality": lambda s, d: insights.seasonality(one(s, d, "monthly")),
    "peak_month": lambda s, d: insights.peak_month(one(s, d, "monthly")),
    "cause_shares": lambda s, d: insights.cause_shares(one(s, d, "delaySummary")),
    "best_carrier": lambda s, d: rankings.best_carrier(one(s, d, "airlines"), MIN_FLIGHTS),
    "worst_carrier": lambda s, d: rankings.worst_carrier(one(s, d, "airlines"), MIN_FLIGHTS),
    "busiest_airport": lambda s, d: rankings.busiest_airport(one(s, d, "airports")),
    "dominant_cause": lambda s, d: insights.dominant_cause(one(s, d, "delaySummary")),
    "cancellation_grade": lambda s, d: insights.cancellation_health(one(s, d, "delaySummary")),
    "kpi_rows": lambda s, d: insights.kpi_rows(one(s, d, "delaySummary")),
    "insights": lambda s, d: insights.insights_from_grains(agg.grain_table(flights(s, d)),
                                                           MIN_FLIGHTS),
    # step 5: keyed items, upsert, sinks and served reads
    "keyed_items_airlines": _keyed("airlines"),
    "keyed_items_airports": _keyed("airports"),
    "keyed_items_monthly": _keyed("monthly"),
    "keyed_items_summary": _keyed("delaySummary"),
    "keyed_upsert": keyed_upsert,
    "keyed_store_roundtrip": keyed_store_roundtrip,
    "keyed_upsert_new_column": keyed_upsert_new_column,
    "keyed_pages": keyed_pages,
    "keyed_repeated_keys": keyed_repeated_keys,
    "uneven_rows_csv": uneven_rows_csv,
    "decimal_nested": decimal_nested,
    "served_read_broken_store": served_read_broken_store,
    "json_roundtrip": json_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "served_read": served_read,
    "served_read_fallback": served_read_fallback,
    "readiness": lambda s, d: checks.readiness(_outputs(s, d).as_dict()),
    "replay_load": replay_load,
    # step 6: holidays
    "holiday_records": lambda s, d: hol.normalise_holidays(_payload(s, d)).drop("_order"),
    "holidays_normalised": lambda s, d: hol.holiday_store(_payload(s, d)),
    "holidays_by_date": lambda s, d: hol.holidays_by_date(hol.holiday_store(_payload(s, d))),
    "holidays_archive_roundtrip": holidays_archive_roundtrip,
    # step 7: one-pass forms and the full run
    "all_grains": lambda s, d: agg.grain_table(flights(s, d)),
    "grains_by_airline": lambda s, d: agg.airline_from_grains(agg.grain_table(flights(s, d))),
    "grains_by_airport_top50": lambda s, d: agg.airport_top_from_grains(
        agg.grain_table(flights(s, d))),
    "grains_by_month": lambda s, d: agg.month_from_grains(agg.grain_table(flights(s, d))),
    "grains_summary": lambda s, d: agg.summary_from_grains(agg.grain_table(flights(s, d))),
    "run_source_profile": run_source_profile,
    "streaming_by_airline": _streamed_output("airlines"),
    "streaming_csv_by_airline": streaming_csv_by_airline,
    "csv_sources_by_airline": csv_sources_by_airline,
    "csv_sources_profile": csv_sources_profile,
    "streaming_by_month": _streamed_output("monthly"),
    "streaming_summary": _streamed_output("delaySummary"),
    "streaming_keyed_airlines": streaming_keyed_airlines,
    "run_null_airline": run_null_airline,
    "rollup_by_airline": lambda s, d: agg.airline_from_rollup(agg.flight_rollup(flights(s, d))),
    "rollup_by_airport_top50": lambda s, d: agg.airport_top_from_rollup(
        agg.flight_rollup(flights(s, d))),
    "rollup_by_month": lambda s, d: agg.month_from_rollup(agg.flight_rollup(flights(s, d))),
    "rollup_summary": lambda s, d: agg.summary_from_rollup(agg.flight_rollup(flights(s, d))),
}


def queries() -> dict[str, Query]:
    return {**QUERIES, **INPUT_QUERIES}
