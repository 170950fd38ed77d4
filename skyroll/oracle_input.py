"""DuckDB SQL of the queries over raw input as it lands (``registry_input``)."""

from __future__ import annotations

from skyroll import registry_input as rules
from skyroll.oracle import AGGREGATES, FIXTURE, HOLIDAYS, ORACLE, D, _q
from skyroll.registry import PAGE_ITEMS
from skyroll.schemas import source_specs

_SOURCE = "CASE WHEN CAST(yr AS INTEGER) <= 2017 THEN '2015' ELSE '2018_2024' END"
_REST = f"CAST(distance AS INTEGER) % {rules.FAULT_CYCLE}"
_BAD = f"{_REST} IN ({rules.SHORT}, {rules.LONG})"
_GOOD_FIXTURE = FIXTURE.removesuffix("FROM fixture)") + f"FROM fixture WHERE NOT ({_BAD}))"
_YEARS = ", ".join(f"'{y}'" for y in rules.CORRECTED_YEARS)


def _line(count: int) -> str:
    cells = ["yr", "mo", "dy", "dow", "airline", "origin", "dest", "arr_delay", "dep_delay",
             "carrier_d", "weather_d", "nas_d", "security_d", "late_d", "cancelled", "diverted",
             "distance"][:count]
    return " || ',' || ".join(f"coalesce({c}, '')" for c in cells)


_WIDTH = len(source_specs()[0].columns)
_REJECTS = f"""r AS (SELECT {_SOURCE} AS source,
  CASE WHEN {_REST} = {rules.SHORT} THEN {_line(_WIDTH - 2)} ELSE {_line(_WIDTH)} || ',x,y' END AS line
  FROM fixture WHERE {_BAD})"""

_FILE = f'(31 * "year" + position // {rules.POSITIONS_PER_FILE}) % {rules.FILE_CYCLE}'
_FILES = f"""files AS (SELECT "year", position // {rules.POSITIONS_PER_FILE} AS part,
  CASE WHEN any_value({_FILE}) = {rules.BROKEN_FILE} THEN 'unreadable'
       WHEN any_value({_FILE}) = {rules.OBJECT_FILE} THEN 'not a list' ELSE 'ok' END AS status,
  count(*) AS n, count(*) FILTER (WHERE position % {rules.DATELESS} <> 0) AS good
  FROM hp GROUP BY "year", position // {rules.POSITIONS_PER_FILE})"""
_READABLE = HOLIDAYS.replace(
    "position FROM hp)",
    f"position FROM hp WHERE position % {rules.DATELESS} <> 0 "
    f"AND {_FILE} NOT IN ({rules.BROKEN_FILE}, {rules.OBJECT_FILE}))")

SQL = {
    "mixed_headers_by_airline": ORACLE["by_airline"],
    "mixed_headers_extras": f"""WITH {FIXTURE} SELECT {_SOURCE} AS source,
  CASE CAST(dy AS INTEGER) % 3 WHEN 1 THEN 'N1' WHEN 2 THEN 'a, "b"' END AS TAIL_MARK,
  CASE WHEN CAST(dy AS INTEGER) % 3 = 2 THEN '7' END AS TAXI_MARK, count(*) AS rows
  FROM fixture GROUP BY ALL""",
    "rejected_rows": f"""WITH {FIXTURE} SELECT {_SOURCE} AS source, yr AS file, count(*) AS rows_in,
  count(*) FILTER (WHERE NOT ({_BAD})) AS rows_ok, count(*) FILTER (WHERE {_BAD}) AS rows_rejected
  FROM fixture GROUP BY ALL""",
    "rejected_lines": f"""WITH {FIXTURE}, {_REJECTS}
  SELECT source, CAST(len(string_split(line, ',')) AS INTEGER) AS fields, count(*) AS lines,
  min(line) AS first_line FROM r GROUP BY ALL""",
    "landed_by_airline": f"WITH {_GOOD_FIXTURE},{AGGREGATES}\nSELECT * FROM airlines_out",
    "landed_observed_totals": f"""WITH {FIXTURE} SELECT count(*) AS rows_in,
  count(*) FILTER (WHERE NOT ({_BAD})) AS rows_ok, count(*) FILTER (WHERE {_BAD}) AS rows_rejected,
  count(*) FILTER (WHERE airline IS NULL AND NOT ({_BAD})) AS null_airline_rows FROM fixture""",
    "run_observed_profile": f"""WITH {FIXTURE} SELECT {_SOURCE} AS source, count(*) AS raw_rows,
  count(*) FILTER (WHERE airline IS NULL) AS null_airline_rows FROM fixture GROUP BY ALL""",
    "redelivered_by_airline": ORACLE["by_airline"],
    "redelivered_versions": f"""WITH {FIXTURE} SELECT {_SOURCE} AS source,
  'delivery=' || yr AS delivery, CASE WHEN yr IN ({_YEARS}) THEN 2 ELSE 1 END AS version,
  count(*) AS rows FROM fixture GROUP BY ALL""",
    "keyed_pages": f"""SELECT *, CAST((row_number() OVER (ORDER BY item_key) - 1) // {PAGE_ITEMS} AS INTEGER)
  AS page FROM ({ORACLE['keyed_upsert']})""",
    "keyed_repeated_keys": f"""WITH {FIXTURE}, m AS (SELECT AIRLINE, "YEAR", "MONTH", count(*) AS flights
  FROM flights WHERE AIRLINE IS NOT NULL GROUP BY ALL)
  SELECT AIRLINE AS item_key, * FROM m
  QUALIFY row_number() OVER (PARTITION BY AIRLINE ORDER BY "YEAR" DESC, "MONTH" DESC) = 1""",
    "uneven_rows_csv": """SELECT CAST(o_orderkey AS VARCHAR) AS "order",
  CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS status,
  CASE WHEN o_custkey % 4 = 0 THEN concat('said "', o_orderpriority, '",', chr(10), 'then left') END
    AS "the note",
  CASE WHEN o_custkey % 5 = 0 THEN concat('["a,b","', o_orderstatus, '"]') END AS tags,
  CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey > 100 AS VARCHAR) END AS large FROM orders""",
    "decimal_nested": _q(f"""SELECT AIRLINE AS item_key, {D('carrier_delay')} AS first,
  {D('weather_delay')} AS second, {D('arrival_delay')} AS arrival, {D('cancelled')} AS cancelled,
  {D('departure_delay / 3')} AS third_of_departure FROM airlines_out WHERE AIRLINE IS NOT NULL"""),
    "served_read_broken_store": _q("SELECT *, 'json-fallback' AS data_source FROM airlines_out"),
    "holiday_years_status": f"""WITH {HOLIDAYS}, {_FILES} SELECT "year", part, status,
  CASE WHEN status = 'ok' THEN n ELSE 0 END AS records,
  CASE WHEN status = 'ok' THEN good ELSE 0 END AS kept,
  CASE WHEN status = 'ok' THEN n - good ELSE 0 END AS rejected FROM files""",
    "holiday_years_read": f"WITH {_READABLE}\nSELECT * EXCLUDE (position) FROM hn",
    "holiday_years_loaded": f"WITH {_READABLE}\nSELECT * FROM hs",
}
