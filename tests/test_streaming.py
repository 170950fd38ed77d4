import os

from skyroll.operators import aggregates as agg
from skyroll.plans.replay import output_schemas
from skyroll.registry import flights, raw_sources
from skyroll.sources.json_lines import read_json_output
from skyroll.streaming.incremental import start_incremental_run

from support import SF_SMALL, rows


def _land(raw, root, parts=4):
    landing = {}
    for label, df in raw.items():
        landing[label] = f"{root}/landing/{label}"
        df.repartition(parts).write.option("header", "true").csv(landing[label])
    return landing


def _run(spark, landing, root, ckpt):
    q = start_incremental_run(spark, landing, f"{root}/out", f"{root}/store",
                              checkpoint_location=ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_stream_restart_resumes_from_state(spark, tmp_dir):
    raw = raw_sources(spark, SF_SMALL)
    schemas = output_schemas(spark)
    early = {"2015": raw["2015"]}
    ckpt = f"{tmp_dir}/ckpt"
    # first only the 2015 layout has landed
    landing = _land(early, tmp_dir)
    landing["2018_2024"] = f"{tmp_dir}/landing/2018_2024"
    os.makedirs(landing["2018_2024"])
    q1 = _run(spark, landing, tmp_dir, ckpt)
    assert q1.lastProgress is not None
    part = rows(read_json_output(spark, f"{tmp_dir}/out/airlines", schemas["airlines"]))
    assert sum(r[1] for r in part) == raw["2015"].count()
    # the later layout lands; the restarted query only reads the new files
    raw["2018_2024"].repartition(3).write.mode("append").option("header", "true") \
        .csv(landing["2018_2024"])
    _run(spark, landing, tmp_dir, ckpt)
    fact = flights(spark, SF_SMALL)
    for name, direct in [("airlines", agg.by_airline(fact)),
                         ("monthly", agg.by_month(fact)),
                         ("delaySummary", agg.summary(fact))]:
        got = read_json_output(spark, f"{tmp_dir}/out/{name}", schemas[name])
        assert rows(got) == rows(direct), name


def test_additive_grains_merge(spark):
    fact = flights(spark, SF_SMALL)
    a, b = fact.randomSplit([0.3, 0.7], seed=11)
    merged = agg.merge_additive(agg.additive_grain_table(a), agg.additive_grain_table(b))
    got = agg.grains_from_additive(merged)
    want = agg.grain_table(fact)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
