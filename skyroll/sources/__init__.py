"""Sources: raw flight files, the generated flight fixture, aggregate JSON,
holiday payloads and keyed-store snapshots."""

from skyroll.sources.raw import read_raw_csv, read_sources
from skyroll.sources.fixture import fixture_sources, fixture_flights_raw
from skyroll.sources.json_lines import read_json_output

__all__ = ["read_raw_csv", "read_sources", "fixture_sources", "fixture_flights_raw",
           "read_json_output"]
