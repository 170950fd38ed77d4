import json

from skyroll.sources.holidays import (
    archive_holidays, holiday_store, holidays_by_date, read_holiday_archive, read_holiday_arrays,
)

from support import rows


def _write_year(path, year, items):
    with open(f"{path}/{year}.json", "w") as f:
        json.dump(items, f, separators=(",", ":"))


def test_array_payloads_defaults_and_last_wins(spark, tmp_dir):
    _write_year(tmp_dir, 2019, [
        {"date": "2019-01-01", "name": "New Year's Day", "localName": "NYD", "fixed": True,
         "global": True, "types": ["Public"]},
        {"date": "2019-07-04", "localName": "Fourth", "types": None},
        {"date": "2019-07-04", "name": "Independence Day", "localName": "July 4th",
         "fixed": False, "global": True, "types": ["Public", "Bank"]},
    ])
    _write_year(tmp_dir, 2020, [{"date": "2020-12-25", "name": "Christmas"}])
    payload = read_holiday_arrays(spark, tmp_dir)
    assert rows(payload, "year", "position", "date") == [
        (2019, 0, "2019-01-01"), (2019, 1, "2019-07-04"), (2019, 2, "2019-07-04"),
        (2020, 0, "2020-12-25")]
    store = {r.date: r for r in holiday_store(payload).collect()}
    assert len(store) == 3
    july = store["2019-07-04"]
    assert july.name == "Independence Day" and july.types == ["Public", "Bank"]
    xmas = store["2020-12-25"]
    assert (xmas.localName, xmas.fixed, xmas.types, xmas.month, xmas.day) == ("", False, [], 12, 25)
    listing = [r.date for r in holidays_by_date(holiday_store(payload)).collect()]
    assert listing == sorted(listing)


def test_archive_replaces_only_rewritten_years(spark, tmp_dir):
    _write_year(tmp_dir, 2019, [{"date": "2019-01-01", "name": "a"}])
    _write_year(tmp_dir, 2020, [{"date": "2020-01-01", "name": "b"}])
    payload = read_holiday_arrays(spark, tmp_dir)
    root = f"{tmp_dir}/archive"
    archive_holidays(payload, root)
    again = payload.filter("year = 2020").withColumn("name", payload["name"].substr(1, 0))
    archive_holidays(again, root)
    got = rows(read_holiday_archive(spark, root), "year", "name")
    assert got == [(2019, "a"), (2020, "")]
