"""The batch run as a Structured Streaming job over landing folders.

New raw files (either layout) land in per-layout folders. The stream reads
them as headered CSV with an explicit all-string schema, standardises them
with the batch code, and keeps an *additive* grain table - counts and sums
per carrier, airport, month, network and source - as streaming state. The
state lives in Spark's fault-tolerant state store under the query's
checkpoint location, so a restarted or failed query resumes exactly where
it stopped; its size is bounded by the number of groups, never by the
number of flights.

Each micro-batch hands the complete state table (output mode ``complete``)
to ``publish``, which derives the four outputs exactly as the batch run does
and writes them: JSON replacing the folders, keyed items upserted as a new
snapshot. Both writes are idempotent, so a micro-batch replayed after a
failure leaves the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyroll.operators.aggregates import additive_grain_table, grains_from_additive
from skyroll.operators.standardise import standardise, unify
from skyroll.plans.dashboard import outputs_from_grains
from skyroll.plans.run import publish_outputs
from skyroll.schemas import SourceSpec, raw_schema, source_specs
from skyroll.session import scratch_path

SOURCE_COL = "source"


def landed_schema(spark: SparkSession, spec: SourceSpec) -> T.StructType:
    """The header of the files that have landed, all strings. With a schema Spark
    binds CSV columns by place, so the schema must be the files' own header; a
    file with another header then fails the stream instead of being misread. An
    empty landing folder expects the mapped columns in mapping order."""
    try:
        return (spark.read.option("header", "true").option("pathGlobFilter", "*.csv")
                .csv(spec.path)).schema
    except AnalysisException as exc:
        if exc.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return raw_schema(spec)


def flight_stream(spark: SparkSession, landing: dict[str, str],
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming canonical fact over the landing folders, tagged by layout."""
    parts = []
    for spec in source_specs(landing):
        if not spec.path:
            continue
        reader = (spark.readStream.schema(landed_schema(spark, spec))
                  .option("header", "true")
                  .option("enforceSchema", "false")
                  .option("pathGlobFilter", "*.csv"))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        raw = reader.csv(spec.path)
        parts.append(standardise(raw, spec).withColumn(SOURCE_COL, F.lit(spec.label)))
    return unify(parts)


def publish(state: DataFrame, out_root: str, store_root: str | None) -> None:
    """Write the four outputs derived from the current additive state."""
    outputs = outputs_from_grains(grains_from_additive(state)).as_dict()
    publish_outputs(state.sparkSession, outputs, out_root, store_root, strict=True)


def start_incremental_run(spark: SparkSession, landing: dict[str, str], out_root: str,
                          store_root: str | None = None,
                          checkpoint_location: str | None = None,
                          available_now: bool = True,
                          processing_time: str | None = None,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the incremental run. ``available_now`` processes what has landed
    (in several micro-batches if ``max_files_per_trigger`` is set) and stops;
    otherwise the query keeps polling every ``processing_time``."""
    state = additive_grain_table(flight_stream(spark, landing, max_files_per_trigger),
                                 extra_sets={SOURCE_COL: [SOURCE_COL]})

    def on_batch(batch: DataFrame, _epoch_id: int) -> None:
        # The state table is small (one row per group); keep it for the
        # several writes of this batch instead of recomputing it per write.
        batch.persist()
        try:
            publish(batch, out_root, store_root)
        finally:
            batch.unpersist()

    writer = (state.writeStream.outputMode("complete").foreachBatch(on_batch)
              .option("checkpointLocation",
                      checkpoint_location or scratch_path(spark, "stream-state")))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
