"""The full batch run (CMP3): sources -> fact -> four aggregates -> sinks.

Plan, sized for a fact of many TB:

1. every raw source is scanned once, standardised (one projection) and
   tagged with its label; the union is never cached;
2. one grouping-sets aggregate computes the carrier, airport, month and
   network grains plus the per-source row counts in that same pass; each
   task pre-aggregates to a few hundred groups, so the shuffle is tiny;
3. that small grain table is written to the shared checkpoint folder and
   read back, which cuts the lineage: the outputs, checks and sinks never
   re-scan the raw files, and a lost executor never forces a re-scan;
   the rows of each source are also observed as that job reads them
   (``RunResult.observed``): a cheap check. A map task that runs again after a
   lost executor is observed twice, so the reported profile comes from the grains;
4. each output is written as JSON (replacing the folder) and upserted into
   the keyed store as a new committed snapshot.

Running the same inputs twice yields the same JSON and the same store
content.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyroll.operators.aggregates import grain_table
from skyroll.operators.checks import run_totals
from skyroll.operators.standardise import standardise, unify
from skyroll.plans.dashboard import Outputs, outputs_from_grains
from skyroll.schemas import KEYED_OUTPUTS, SourceSpec, source_specs
from skyroll.session import scratch_path
from skyroll.sinks.json_out import write_json_output
from skyroll.sinks.keyed import KeyedStore, keyed_items

log = logging.getLogger("skyroll.run")

SOURCE_COL = "source"


@dataclass
class RunResult:
    outputs: Outputs
    source_profile: DataFrame
    null_airline: DataFrame
    totals: DataFrame
    grains_path: str
    observed: dict[str, dict[str, int]]
    store_versions: dict[str, int] = field(default_factory=dict)
    store_errors: dict[str, str] = field(default_factory=dict)


def labelled_flights(raw_by_label: dict[str, DataFrame],
                     specs: list[SourceSpec] | None = None,
                     observations: dict[str, Observation] | None = None) -> DataFrame:
    """The fact with its source labels. ``observations`` (by label) count rows and rows
    without a carrier as they pass by, in whatever job reads the fact first."""
    by_label = {s.label: s for s in (specs or source_specs())}
    parts = []
    for label, df in raw_by_label.items():
        part = standardise(df, by_label[label])
        if observations:
            part = part.observe(observations[label], F.count(F.lit(1)).alias("raw_rows"),
                                F.count_if(F.col("AIRLINE").isNull()).alias("null_airline_rows"))
        parts.append(part.withColumn(SOURCE_COL, F.lit(label)))
    return unify(parts)


def materialise_grains(spark: SparkSession, flights: DataFrame) -> tuple[DataFrame, str]:
    """Compute the grain table in one pass and persist it in the shared
    checkpoint folder (reliable, unlike a local checkpoint)."""
    table = grain_table(flights, extra_sets={SOURCE_COL: [SOURCE_COL]})
    path = scratch_path(spark, "grains")
    table.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path), path


def publish_outputs(spark: SparkSession, outputs: dict[str, DataFrame], out_root: str,
                    store_root: str | None = None, strict: bool = True
                    ) -> tuple[dict[str, int], dict[str, str]]:
    """Write each output as JSON, then upsert it into the keyed store.

    The four outputs are independent small jobs, so the driver submits them
    concurrently (Spark schedules jobs from several threads) instead of one
    after another. Every JSON output is written even if a store write fails;
    in strict mode the first store failure is raised afterwards, otherwise
    it is logged and returned. Returns (store versions, store errors).
    """
    versions: dict[str, int] = {}
    errors: dict[str, str] = {}
    failures: list[BaseException] = []

    def publish(name: str) -> None:
        df = outputs[name]
        write_json_output(df, f"{out_root}/{name}")
        if not store_root:
            return
        store_table, rule = KEYED_OUTPUTS[name]
        try:
            store = KeyedStore(spark, store_root, store_table)
            versions[name] = store.upsert(keyed_items(df, rule))
        except Exception as exc:  # noqa: BLE001
            if strict:
                failures.append(exc)
                return
            log.warning("keyed store write failed for %s: %s", name, exc)
            errors[name] = str(exc)

    with ThreadPoolExecutor(max_workers=len(outputs)) as pool:
        for fut in [pool.submit(publish, name) for name in outputs]:
            fut.result()
    if failures:
        raise failures[0]
    return versions, errors


def run(spark: SparkSession, raw_by_label: dict[str, DataFrame], out_root: str,
        store_root: str | None = None, strict: bool = True) -> RunResult:
    """Run the batch job. With ``strict`` a keyed-store failure is raised
    (after the JSON outputs are written); otherwise it is logged and kept in
    ``store_errors``."""
    columns = {label: len(df.columns) for label, df in raw_by_label.items()}
    seen = {label: Observation(f"source-{label}") for label in raw_by_label}
    table, path = materialise_grains(spark, labelled_flights(raw_by_label, observations=seen))
    observed = {label: dict(o.get) for label, o in seen.items()}
    outputs = outputs_from_grains(table)

    versions, errors = publish_outputs(spark, outputs.as_dict(), out_root, store_root, strict)

    width = F.create_map(*[x for label, n in columns.items() for x in (F.lit(label), F.lit(n))])
    profile = (table.filter(F.col("grain") == SOURCE_COL)
               .select(F.col(SOURCE_COL).alias("source"), F.col("n").alias("raw_rows"),
                       width[F.col(SOURCE_COL)].alias("raw_columns")))
    grain = F.col("grain")
    null_airline = table.agg(
        F.sum(F.when(grain == "all", F.col("n"))).alias("total_rows"),
        F.coalesce(F.sum(F.when((grain == "airline") & F.col("AIRLINE").isNull(), F.col("n"))),
                   F.lit(0).cast("bigint")).alias("null_airline_rows"))
    totals = run_totals(outputs.summary, outputs.airlines, outputs.airports, outputs.monthly)
    return RunResult(outputs, profile, null_airline, totals, path, observed, versions, errors)
