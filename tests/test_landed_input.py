"""Raw input as it lands: other headers, broken lines, deliveries that come again,
holiday files that can't be read."""

import gzip
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from skyroll.operators.aggregates import by_airline
from skyroll.operators.standardise import MissingColumnError, standardise
from skyroll.plans.deliveries import Deliveries
from skyroll.plans.holidays import load_holidays
from skyroll.plans.landing import land
from skyroll.schemas import source_specs
from skyroll.sinks.keyed import KeyedStore
from skyroll.sources.headers import FILE, REJECTED, headers, list_files, read_raw_groups
from skyroll.sources.holidays import holiday_files, holiday_status, read_holiday_arrays
from support import rows

SPEC = {s.label: s for s in source_specs()}["2015"]
COLS = SPEC.source_columns


def line(columns=COLS, **values):
    base = {c: "1" for c in columns} | {"YEAR": "2015", "AIRLINE": "AA", "ORIGIN_AIRPORT": "JFK"}
    return ",".join({**base, **values}[c] for c in columns)


def put(path, *lines, opener=open):
    path.parent.mkdir(parents=True, exist_ok=True)
    with opener(path, "wt") as f:
        f.write("\n".join(lines) + "\n" if lines else "")


# -------------------------------------------------------------- header groups

def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    put(tmp_path / "a.csv", ",".join(COLS), line(AIRLINE="AA", ARRIVAL_DELAY="5"))
    turned = ["extra, one", *reversed(COLS)]
    put(tmp_path / "deep" / "b.csv", ",".join(f'"{c}"' for c in turned),
        '"x, y",' + line(list(reversed(COLS)), AIRLINE="BB", ARRIVAL_DELAY="7"))
    put(tmp_path / "c.csv", "﻿" + ",".join(c.lower() for c in COLS), line(AIRLINE="CC"))
    put(tmp_path / "empty.csv")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write(",".join(COLS) + "\n" + line(AIRLINE="DD") + "\n")
    raw = read_raw_groups(spark, [str(tmp_path)], SPEC)
    assert raw.columns == [*COLS, "extra, one"]
    assert rows(raw, "AIRLINE", "ARRIVAL_DELAY", "extra, one") == [
        ("AA", "5", None), ("BB", "7", "x, y"), ("CC", "1", None)]
    zipped = list_files(spark, str(tmp_path), "*.gz")
    assert [list(h) for h in headers(spark, zipped)] == [COLS]
    assert rows(read_raw_groups(spark, str(tmp_path), SPEC).select("AIRLINE"), "AIRLINE") == [
        ("AA",), ("BB",), ("CC",)]
    assert standardise(raw, SPEC).where("YEAR = 2015").count() == 3


def test_a_lacking_column_names_its_files(spark, tmp_path):
    put(tmp_path / "good.csv", ",".join(COLS), line())
    less = [c for c in COLS if c not in ("DISTANCE", "AIRLINE")]
    put(tmp_path / "poor.csv", ",".join(less), line(less))
    with pytest.raises(MissingColumnError) as told:
        read_raw_groups(spark, str(tmp_path), SPEC)
    assert "'DISTANCE'" in str(told.value) and "'AIRLINE'" in str(told.value)
    assert "poor.csv" in str(told.value) and "good.csv" not in str(told.value)


def test_repeated_names_in_a_header(spark, tmp_path):
    names = [*COLS, "mark", "MARK"]
    put(tmp_path / "a.csv", ",".join(names), line() + ",first,second")
    raw = read_raw_groups(spark, str(tmp_path), SPEC)
    assert raw.columns[-2:] == ["mark", "MARK__2"]
    assert rows(raw, "mark", "MARK__2") == [("first", "second")]


def test_no_files_give_no_rows(spark, tmp_path):
    put(tmp_path / "empty.csv")
    raw = read_raw_groups(spark, str(tmp_path), SPEC, rejects=True)
    assert raw.count() == 0 and raw.columns == [*COLS, REJECTED, FILE]


# ------------------------------------------------------------- rejected lines

def test_short_and_long_lines_are_kept_apart(spark, tmp_path):
    put(tmp_path / "in" / "a.csv", ",".join(COLS), line(), line() + ",9", "2015,1,1",
        line(AIRLINE=""), line(AIRLINE='"A,A"'))
    put(tmp_path / "in" / "b.csv", ",".join(["X", *COLS]), "x," + line(), line())
    landed = land(spark, {"2015": str(tmp_path / "in")}, str(tmp_path / "fact"))
    assert {r.line for r in landed.rejects.collect()} == {line() + ",9", "2015,1,1", line()}
    assert rows(landed.flights, "AIRLINE") == [("A,A",), ("AA",), ("AA",), (None,)]
    counts = {os.path.basename(r.file): (r.rows_in, r.rows_ok, r.rows_rejected)
              for r in landed.counts.collect()}
    assert counts == {"a.csv": (5, 3, 2), "b.csv": (2, 1, 1)}
    assert landed.totals == {"rows_in": 7, "rows_ok": 4, "rows_rejected": 3,
                             "null_airline_rows": 1}


def test_landing_scans_the_files_once(spark, tmp_path):
    put(tmp_path / "in" / "a.csv", ",".join(COLS), line(), "short")
    landed = land(spark, {"2015": str(tmp_path / "in")}, str(tmp_path / "fact"))
    for df in (landed.flights, landed.rejects, landed.counts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "csv" not in plan.lower().replace("a.csv", "") and "parquet" in plan.lower()


# ----------------------------------------------------------------- deliveries

def state(deliveries):
    return rows(deliveries.outputs().airlines, "AIRLINE", "flights", "arrival_delay")


def test_a_corrected_delivery_replaces_itself(spark, tmp_path):
    land_at = tmp_path / "in"
    put(land_at / "jan" / "a.csv", ",".join(COLS), line(ARRIVAL_DELAY="10"), line(ARRIVAL_DELAY="20"))
    put(land_at / "feb" / "a.csv", ",".join(COLS), line(AIRLINE="BB", ARRIVAL_DELAY="1"))
    landing = {"2015": str(land_at)}
    d = Deliveries(spark, str(tmp_path / "state"))
    assert d.outputs() is None
    assert d.refresh(landing) == 1 and state(d) == [("AA", 2, 15.0), ("BB", 1, 1.0)]
    # nothing new: nothing is read or written
    assert d.refresh(landing) is None
    # the correction has another header too, and one file more
    put(land_at / "jan" / "a.csv", ",".join(reversed(COLS)), line(list(reversed(COLS)), ARRIVAL_DELAY="30"))
    put(land_at / "jan" / "b.csv", ",".join(COLS), line(AIRLINE="CC"), "short")
    changed = Deliveries(spark, str(tmp_path / "state")).changes(landing)
    assert rows(changed, "delivery") == [("jan",)]
    assert d.refresh(landing) == 2
    assert state(d) == [("AA", 1, 30.0), ("BB", 1, 1.0), ("CC", 1, 1.0)]


def test_a_delivery_that_is_gone_or_empty_adds_nothing(spark, tmp_path):
    land_at = tmp_path / "in"
    put(land_at / "jan" / "a.csv", ",".join(COLS), line())
    put(land_at / "feb" / "a.csv", ",".join(COLS), line(AIRLINE="BB"))
    put(land_at / "mar" / "a.csv", ",".join(COLS), line(AIRLINE="CC"))
    landing = {"2015": str(land_at)}
    d = Deliveries(spark, str(tmp_path / "state"))
    d.refresh(landing)
    os.rename(land_at / "feb", tmp_path / "withdrawn")
    put(land_at / "mar" / "a.csv", ",".join(COLS))
    d.refresh(landing)
    assert [a for a, *_ in state(d)] == ["AA"]
    os.rename(tmp_path / "withdrawn", land_at / "feb")
    d.refresh(landing)
    assert [a for a, *_ in state(d)] == ["AA", "BB"]


def test_a_refresh_that_fails_is_not_seen_and_done_again(spark, tmp_path):
    land_at = tmp_path / "in"
    put(land_at / "jan" / "a.csv", ",".join(COLS), line())
    landing = {"2015": str(land_at)}
    d = Deliveries(spark, str(tmp_path / "state"))
    d.refresh(landing)
    put(land_at / "jan" / "a.csv", ",".join(COLS), line(), line())
    # all is written and the commit fails
    d.snapshots.commit = lambda folder, version: 1 / 0
    with pytest.raises(ZeroDivisionError):
        d.refresh(landing)
    d = Deliveries(spark, str(tmp_path / "state"))
    assert [n for _, n, _ in state(d)] == [1]
    assert d.refresh(landing) == 2 and [n for _, n, _ in state(d)] == [2]


def test_two_refreshes_at_once_count_once(spark, tmp_path):
    put(tmp_path / "in" / "jan" / "a.csv", ",".join(COLS), line())
    landing = {"2015": str(tmp_path / "in")}
    all_ = [Deliveries(spark, str(tmp_path / "state")) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda d: d.refresh(landing), all_))
    assert sorted(done, key=str) == [1, None, None]
    assert [n for _, n, _ in state(all_[0])] == [1]


def test_deliveries_equal_the_batch_run(spark, tmp_path):
    land_at = tmp_path / "in"
    for k in range(4):
        put(land_at / f"d{k}" / "a.csv", ",".join(COLS),
            *[line(AIRLINE=f"A{i % 3}", ARRIVAL_DELAY=str(i * k)) for i in range(20)])
    d = Deliveries(spark, str(tmp_path / "state"))
    d.refresh({"2015": str(land_at)})
    raw = read_raw_groups(spark, str(land_at), SPEC)
    assert rows(d.outputs().airlines) == rows(by_airline(standardise(raw, SPEC)))


def test_a_delivery_is_named_once_a_file_not_once_a_row(spark, tmp_path):
    for name in ("jan/a", "jan/b", "feb/a"):
        put(tmp_path / "in" / f"{name}.csv", ",".join(COLS), line(), line(AIRLINE="BB"))
    raw = read_raw_groups(spark, str(tmp_path / "in"), SPEC, rejects=True)
    d = Deliveries(spark, str(tmp_path / "state"))
    added = d.added(standardise(raw, SPEC, [FILE]).withColumn("source", F.lit("2015")))
    assert rows(added.where("grain = 'all'"), "delivery", "n") == [("feb", 2), ("jan", 4)]
    per_row = added._jdf.queryExecution().optimizedPlan().toString().split("Expand", 1)[1]
    assert "regexp_extract" not in per_row


# ------------------------------------------------------------------- holidays

def year(path, name, content):
    path.mkdir(exist_ok=True)
    (path / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_a_bad_year_costs_only_itself(spark, tmp_path):
    src = tmp_path / "h"
    year(src, "2018.json", [{"date": "2018-12-25", "name": "Christmas", "types": ["Public"]}])
    year(src, "2019.json", '[{"date": "2019-01-01", "na')
    year(src, "2020.json", {"message": "not found"})
    year(src, "2021.json", [{"date": "2021-07-04", "fixed": True}, {"name": "no date"},
                            {"date": "soon"}, {"date": None}, "text", None,
                            {"date": "2021-07-05", "types": "no list", "global": 1, "name": 7}])
    year(src, "2022.json", [])
    year(src, "latest.json", [{"date": "2030-01-01"}])
    status = holiday_status(holiday_files(spark, str(src)))
    assert sorted(map(tuple, status.collect()), key=str) == sorted([
        (2018, 0, "ok", 1, 1, 0), (2019, 0, "unreadable", 0, 0, 0),
        (2020, 0, "not a list", 0, 0, 0), (2021, 0, "ok", 7, 2, 5), (2022, 0, "ok", 0, 0, 0),
        (None, 0, "no year", 0, 0, 0)], key=str)
    got = read_holiday_arrays(spark, str(src), on_error="skip")
    assert rows(got, "year", "position", "date") == [
        (2018, 0, "2018-12-25"), (2021, 0, "2021-07-04"), (2021, 6, "2021-07-05")]
    odd = got.where("position = 6").first()
    assert (odd.types, odd["global"], odd.name) == (None, True, "7")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_holiday_arrays(spark, str(src)).collect()
    with pytest.raises(ValueError):
        read_holiday_arrays(spark, str(src), on_error="ignore")


def test_load_goes_on_when_the_archive_fails(spark, tmp_path):
    src = tmp_path / "h"
    year(src, "2018.json", [{"date": "2018-12-25"}, {"date": "2018-12-25", "name": "last"}])
    year(src, "2019.json", "not json")
    (tmp_path / "taken").write_text("a file where the archive should go")
    store = KeyedStore(spark, str(tmp_path / "store"), "flight_holidays")
    done = load_holidays(spark, str(src), store, str(tmp_path / "taken"))
    assert done.archive_error and done.store_version == 1
    assert rows(store.read(), "item_key", "name") == [("2018-12-25", "last")]
    assert rows(done.status, "year", "status") == [(2018, "ok"), (2019, "unreadable")]
    again = load_holidays(spark, str(src), store, str(tmp_path / "archive"))
    assert again.archive_error is None and again.store_version == 2


def test_only_bad_years_store_nothing(spark, tmp_path):
    year(tmp_path / "h", "2019.json", "[")
    store = KeyedStore(spark, str(tmp_path / "store"), "flight_holidays")
    done = load_holidays(spark, str(tmp_path / "h"), store)
    assert done.store_version is None and store.read() is None
