import os

import pytest

from skyroll.plans.replay import replay
from skyroll.plans.run import run
from skyroll.schemas import KEYED_OUTPUTS
from skyroll.sinks.keyed import KeyedStore
from skyroll.sources.fixture import fixture_sources
from skyroll.sources.json_lines import read_json_output
from skyroll.sources.served import DatasetNotReady, load_dataset

from support import SF_SMALL, rows


def _json_rows(spark, folder, schema):
    return rows(read_json_output(spark, folder, schema))


def test_run_twice_gives_same_outputs(spark, tmp_dir):
    raw = fixture_sources(spark, SF_SMALL)
    first = run(spark, raw, f"{tmp_dir}/json", f"{tmp_dir}/store")
    snap1 = {n: _json_rows(spark, f"{tmp_dir}/json/{n}", df.schema)
             for n, df in first.outputs.as_dict().items()}
    store1 = {n: rows(KeyedStore(spark, f"{tmp_dir}/store", t).read())
              for n, (t, _) in KEYED_OUTPUTS.items()}
    second = run(spark, raw, f"{tmp_dir}/json", f"{tmp_dir}/store")
    snap2 = {n: _json_rows(spark, f"{tmp_dir}/json/{n}", df.schema)
             for n, df in second.outputs.as_dict().items()}
    store2 = {n: rows(KeyedStore(spark, f"{tmp_dir}/store", t).read())
              for n, (t, _) in KEYED_OUTPUTS.items()}
    assert snap1 == snap2 and store1 == store2
    assert second.store_versions == {n: 2 for n in KEYED_OUTPUTS}
    # the JSON keeps the NULL-carrier group, the store skips it
    assert any(r[0] is None for r in snap1["airlines"])
    assert len(store1["airlines"]) == len(snap1["airlines"]) - 1
    totals = first.totals.collect()[0]
    assert totals.total_rows == 6000 and totals.airports == 50


def test_profile_and_null_check_from_one_pass(spark, tmp_dir):
    raw = fixture_sources(spark, SF_SMALL)
    res = run(spark, raw, f"{tmp_dir}/json")
    prof = {r.source: (r.raw_rows, r.raw_columns) for r in res.source_profile.collect()}
    assert sum(v[0] for v in prof.values()) == 6000
    assert all(v[1] == 17 for v in prof.values())
    nulls = res.null_airline.collect()[0]
    assert nulls.total_rows == 6000 and nulls.null_airline_rows > 0


def test_store_failure_strict_and_lenient(spark, tmp_dir):
    raw = fixture_sources(spark, SF_SMALL)
    blocker = f"{tmp_dir}/store"
    with open(blocker, "w") as f:           # a file where the store folder should be
        f.write("x")
    with pytest.raises(Exception):
        run(spark, raw, f"{tmp_dir}/json", blocker)
    res = run(spark, raw, f"{tmp_dir}/json2", blocker, strict=False)
    assert set(res.store_errors) == set(KEYED_OUTPUTS)
    assert os.path.isdir(f"{tmp_dir}/json2/airlines")   # JSON written regardless


def test_served_read_order_of_preference(spark, tmp_dir):
    raw = fixture_sources(spark, SF_SMALL)
    res = run(spark, raw, f"{tmp_dir}/json", f"{tmp_dir}/store")
    schema = res.outputs.airlines.schema
    store = KeyedStore(spark, f"{tmp_dir}/store", "flight_airlines")
    served = load_dataset(spark, store, f"{tmp_dir}/json/airlines", schema)
    assert {r.data_source for r in served.collect()} == {"store"}
    empty_store = KeyedStore(spark, f"{tmp_dir}/nostore", "flight_airlines")
    served = load_dataset(spark, empty_store, f"{tmp_dir}/json/airlines", schema)
    assert {r.data_source for r in served.collect()} == {"json"}

    class Broken(KeyedStore):
        def read(self):
            raise IOError("store down")
    served = load_dataset(spark, Broken(spark, tmp_dir, "x"), f"{tmp_dir}/json/airlines", schema)
    assert {r.data_source for r in served.collect()} == {"json-fallback"}
    with pytest.raises(DatasetNotReady):
        load_dataset(spark, empty_store, f"{tmp_dir}/missing", schema)


def test_replay_counts_exclude_null_keys(spark, tmp_dir):
    raw = fixture_sources(spark, SF_SMALL)
    res = run(spark, raw, f"{tmp_dir}/json")
    counts = {r.output: r.written for r in replay(spark, f"{tmp_dir}/json",
                                                    f"{tmp_dir}/replayed").collect()}
    airlines = res.outputs.airlines.count()
    assert counts["airlines"] == airlines - 1 and counts["delaySummary"] == 1
    store = KeyedStore(spark, f"{tmp_dir}/replayed", "flight_airlines")
    assert store.read().count() == airlines - 1
