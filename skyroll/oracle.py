"""DuckDB SQL equivalents of the registered queries (correctness oracle).

Each statement starts from the driver's tables and re-derives the flight
fixture (FIXTURES.md, F6), cast straight to the canonical schema, then
computes the query with plain SQL. Rounding uses
``CAST(round(CAST(x AS DECIMAL(38,12)), d) AS DOUBLE)``, which matches
Spark's HALF_UP ``round`` on doubles; every LIMIT has a stable tie-break.
"""

from __future__ import annotations

from skyroll.schemas import CAUSES, MONTH_ABBREV, MONTH_NAMES

MIN_FLIGHTS = 3400


def R(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {d}) AS DOUBLE)"


def NUM(x: str) -> str:
    return f"coalesce(CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN 0.0 ELSE CAST({x} AS DOUBLE) END, 0.0)"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


FIXTURE = """
b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_shipdate,
  (l_orderkey + l_suppkey) % 53 = 0 AS cx, (l_orderkey + l_partkey) % 211 = 0 AS dv,
  CAST(floor(l_extendedprice) AS BIGINT) % 140 - 25 AS arr FROM lineitem),
fixture AS (SELECT
  CAST(CAST(year(l_shipdate) AS INT) + 20 AS VARCHAR) AS yr,
  CAST(month(l_shipdate) AS VARCHAR) AS mo, CAST(day(l_shipdate) AS VARCHAR) AS dy,
  CAST(extract(isodow from l_shipdate) AS VARCHAR) AS dow,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('C', lpad(CAST((l_suppkey * 7 + l_partkey) % 17 AS VARCHAR), 2, '0')) END AS airline,
  concat('A', lpad(CAST(l_partkey % 120 AS VARCHAR), 3, '0')) AS origin,
  concat('A', lpad(CAST(l_orderkey % 120 AS VARCHAR), 3, '0')) AS dest,
  CASE WHEN cx OR dv THEN NULL ELSE CAST(arr AS VARCHAR) END AS arr_delay,
  CASE WHEN cx THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) * 2 - 12 AS VARCHAR) END AS dep_delay,
  CASE WHEN NOT cx AND NOT dv AND arr >= 15 THEN CAST(arr % 37 AS VARCHAR) END AS carrier_d,
  CASE WHEN NOT cx AND NOT dv AND arr >= 15 THEN CAST(arr % 11 AS VARCHAR) END AS weather_d,
  CASE WHEN NOT cx AND NOT dv AND arr >= 15 THEN CAST(arr % 23 AS VARCHAR) END AS nas_d,
  CASE WHEN NOT cx AND NOT dv AND arr >= 15 THEN CAST(arr % 3 AS VARCHAR) END AS security_d,
  CASE WHEN NOT cx AND NOT dv AND arr >= 15 THEN CAST(arr % 29 AS VARCHAR) END AS late_d,
  CASE WHEN cx THEN '1' ELSE '0' END AS cancelled,
  CASE WHEN dv AND NOT cx THEN '1' ELSE '0' END AS diverted,
  CAST(100 + l_partkey % 2400 AS VARCHAR) AS distance FROM b),
flights AS (SELECT
  CAST(yr AS INTEGER) AS "YEAR", CAST(mo AS INTEGER) AS "MONTH", CAST(dy AS INTEGER) AS "DAY",
  CAST(dow AS INTEGER) AS DAY_OF_WEEK, airline AS AIRLINE, origin AS ORIGIN_AIRPORT,
  dest AS DESTINATION_AIRPORT, CAST(arr_delay AS DOUBLE) AS ARRIVAL_DELAY,
  CAST(dep_delay AS DOUBLE) AS DEPARTURE_DELAY, CAST(carrier_d AS DOUBLE) AS CARRIER_DELAY,
  CAST(weather_d AS DOUBLE) AS WEATHER_DELAY, CAST(nas_d AS DOUBLE) AS NAS_DELAY,
  CAST(security_d AS DOUBLE) AS SECURITY_DELAY, CAST(late_d AS DOUBLE) AS LATE_AIRCRAFT_DELAY,
  CAST(cancelled AS DOUBLE) AS CANCELLED, CAST(diverted AS DOUBLE) AS DIVERTED,
  CAST(distance AS DOUBLE) AS DISTANCE FROM fixture)"""

AGGREGATES = f"""
airlines_out AS (SELECT AIRLINE, count(*) AS flights,
  {R('avg(CARRIER_DELAY)', 2)} AS carrier_delay, {R('avg(WEATHER_DELAY)', 2)} AS weather_delay,
  {R('avg(NAS_DELAY)', 2)} AS nas_delay, {R('avg(SECURITY_DELAY)', 2)} AS security_delay,
  {R('avg(LATE_AIRCRAFT_DELAY)', 2)} AS late_delay, {R('avg(ARRIVAL_DELAY)', 2)} AS arrival_delay,
  {R('avg(DEPARTURE_DELAY)', 2)} AS departure_delay, {R('avg(CANCELLED)', 4)} AS cancelled,
  {R('avg(DIVERTED)', 4)} AS diverted
  FROM flights GROUP BY AIRLINE),
airports_all AS (SELECT ORIGIN_AIRPORT, count(*) AS flights,
  {R('avg(ARRIVAL_DELAY)', 2)} AS arrival_delay, {R('avg(DEPARTURE_DELAY)', 2)} AS departure_delay,
  {R('avg(CARRIER_DELAY)', 2)} AS carrier_delay, {R('avg(WEATHER_DELAY)', 2)} AS weather_delay,
  {R('avg(NAS_DELAY)', 2)} AS nas_delay, {R('avg(CANCELLED)', 4)} AS cancelled,
  {R('avg(DIVERTED)', 4)} AS diverted
  FROM flights GROUP BY ORIGIN_AIRPORT),
airports_out AS (SELECT * FROM airports_all
  ORDER BY flights DESC, ORIGIN_AIRPORT ASC NULLS LAST LIMIT 50),
monthly_out AS (SELECT "YEAR", "MONTH", count(*) AS flights,
  {R('avg(ARRIVAL_DELAY)', 2)} AS arrival_delay, {R('avg(DEPARTURE_DELAY)', 2)} AS departure_delay,
  {R('avg(CARRIER_DELAY)', 2)} AS carrier_delay, {R('avg(WEATHER_DELAY)', 2)} AS weather_delay,
  {R('avg(CANCELLED)', 4)} AS cancelled
  FROM flights GROUP BY "YEAR", "MONTH"),
summary_out AS (SELECT count(*) AS total_flights,
  {R('avg(ARRIVAL_DELAY)', 2)} AS avg_arrival_delay, {R('avg(DEPARTURE_DELAY)', 2)} AS avg_departure_delay,
  {R('avg(CARRIER_DELAY)', 2)} AS avg_carrier_delay, {R('avg(WEATHER_DELAY)', 2)} AS avg_weather_delay,
  {R('avg(NAS_DELAY)', 2)} AS avg_nas_delay, {R('avg(SECURITY_DELAY)', 2)} AS avg_security_delay,
  {R('avg(LATE_AIRCRAFT_DELAY)', 2)} AS avg_late_delay, {R('avg(CANCELLED)', 4)} AS cancelled_rate,
  {R('avg(DIVERTED)', 4)} AS diverted_rate, {R('avg(DISTANCE)', 2)} AS avg_distance,
  min("YEAR") AS min_year, max("YEAR") AS max_year FROM flights),
airlines_s AS (SELECT * FROM airlines_out WHERE AIRLINE IS NOT NULL),
airports_s AS (SELECT * FROM airports_out WHERE ORIGIN_AIRPORT IS NOT NULL),
monthly_s AS (SELECT * FROM monthly_out WHERE "YEAR" IS NOT NULL AND "MONTH" IS NOT NULL),
season AS (SELECT CAST({NUM('"MONTH"')} AS INTEGER) AS "MONTH",
  {_list(MONTH_NAMES)}[CAST({NUM('"MONTH"')} AS INTEGER)] AS month_name,
  sum(CAST(round({NUM('arrival_delay')} * 100) AS BIGINT)) / (count(*) * CAST(100 AS DOUBLE)) AS avg_arrival_delay,
  count(*) AS periods
  FROM monthly_s WHERE {NUM('"MONTH"')} >= 1 AND {NUM('"MONTH"')} <= 12
  GROUP BY CAST({NUM('"MONTH"')} AS INTEGER)),
peak AS (SELECT p."MONTH", p.month_name, p.avg_arrival_delay,
  {R('n.net', 4)} AS network_avg_delay,
  {R('CASE WHEN n.net <> 0 THEN (p.avg_arrival_delay - n.net) / n.net * 100 ELSE 0.0 END', 4)} AS delta_pct
  FROM (SELECT * FROM season ORDER BY avg_arrival_delay DESC, "MONTH" ASC LIMIT 1) p,
       (SELECT avg(avg_arrival_delay) AS net FROM season) n),
causes AS ({' UNION ALL '.join(
    f"SELECT {i} AS ord, '{label}' AS cause, {NUM(col)} AS value FROM summary_out"
    for i, (label, col) in enumerate(CAUSES, start=1))}),
cause_total AS (SELECT {' + '.join(NUM(col) for _, col in CAUSES)} AS total FROM summary_out),
dominant AS (SELECT cause, value, value / total AS share FROM causes, cause_total
  WHERE total > 0 ORDER BY value DESC, ord ASC LIMIT 1),
health AS (SELECT cancelled_rate, {R(NUM('cancelled_rate') + ' * 100', 2)} AS rate_pct,
  CASE WHEN {NUM('cancelled_rate')} * 100 < 1.5 THEN 'positive'
       WHEN {NUM('cancelled_rate')} * 100 < 2.5 THEN 'info' ELSE 'warning' END AS grade
  FROM summary_out WHERE cancelled_rate IS NOT NULL),
eligible AS (SELECT * FROM airlines_s WHERE {NUM('flights')} > {MIN_FLIGHTS}),
best AS (SELECT AIRLINE, {NUM('arrival_delay')} AS arrival_delay, CAST(flights AS BIGINT) AS flights
  FROM eligible ORDER BY {NUM('arrival_delay')} ASC, AIRLINE ASC NULLS LAST LIMIT 1),
worst AS (SELECT AIRLINE, {NUM('arrival_delay')} AS arrival_delay, CAST(flights AS BIGINT) AS flights
  FROM eligible WHERE (SELECT count(*) FROM eligible) > 1
  ORDER BY {NUM('arrival_delay')} DESC, AIRLINE ASC NULLS LAST LIMIT 1),
busiest AS (SELECT ORIGIN_AIRPORT, CAST({NUM('flights')} AS BIGINT) AS flights,
  {NUM('arrival_delay')} AS arrival_delay
  FROM airports_s ORDER BY {NUM('flights')} DESC, ORIGIN_AIRPORT ASC NULLS LAST LIMIT 1)"""

GRADE_NOTE = """CASE grade WHEN 'positive' THEN 'Cancellations are low.'
  WHEN 'info' THEN 'Cancellations are noticeable; compare the months.'
  WHEN 'warning' THEN 'Cancellations are high; compare the causes.' END"""


def _q(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {FIXTURE},{AGGREGATES}{extra}\n{body}"


def _delay_cols(cols: list[str]) -> str:
    return ", ".join(f"{NUM(c)} AS {c}" for c in cols)


_MATRIX = [("Arrival Delay", "arrival_delay"), ("Departure Delay", "departure_delay"),
           ("Carrier Delay", "carrier_delay"), ("Weather Delay", "weather_delay"),
           ("NAS Delay", "nas_delay")]
_BREAKDOWN = ["carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_delay"]
_SEVERITY = ["arrival_delay", "departure_delay", "carrier_delay", "weather_delay",
             "nas_delay", "security_delay", "late_delay"]
_TOP_AIRPORTS = f"ORDER BY {NUM('flights')} DESC, ORIGIN_AIRPORT ASC NULLS LAST"
_TOP_AIRLINES = f"ORDER BY {NUM('flights')} DESC, AIRLINE ASC NULLS LAST"


def _severity(c: str) -> str:
    return (f"CASE WHEN {NUM(c)} >= 20 THEN 'high' WHEN {NUM(c)} >= 10 THEN 'med' "
            f"ELSE 'low' END AS {c}_class")


def _month_label() -> str:
    m = 'coalesce(CASE WHEN "MONTH" <> 0 THEN "MONTH" END, 1)'
    y = """coalesce(CASE WHEN "YEAR" <> 0 THEN CAST("YEAR" AS VARCHAR) END, '')"""
    return f"concat(coalesce({_list(MONTH_ABBREV)}[{m}], ''), ' ', {y})"


def _kpi() -> str:
    def pct(c: str) -> str:
        return R(f"CAST({c} AS DOUBLE) * 100", 2)
    rows = [
        (1, "Total Flights", "NULL", "CAST(total_flights AS DOUBLE)", "years",
         "CAST(min_year AS DOUBLE)", "CAST(max_year AS DOUBLE)"),
        (2, "Avg Arrival Delay", "'min'", "avg_arrival_delay", "vs dep", "avg_departure_delay", "NULL"),
        (3, "Avg Departure Delay", "'min'", "avg_departure_delay", "carrier", "avg_carrier_delay", "NULL"),
        (4, "Cancellation Rate", "'%'", pct("cancelled_rate"), "diversion", pct("diverted_rate"), "NULL"),
        (5, "Avg Weather Delay", "'min'", "avg_weather_delay", "NAS", "avg_nas_delay", "NULL"),
        (6, "Avg Flight Distance", "'mi'", "avg_distance", "security", "avg_security_delay", "NULL"),
    ]
    parts = [
        f"SELECT {o} AS ord, '{label}' AS label, CAST({unit} AS VARCHAR) AS unit, "
        f"CAST({v} AS DOUBLE) AS value, '{sl}' AS sub_label, CAST({s1} AS DOUBLE) AS sub_value, "
        f"CAST({s2} AS DOUBLE) AS sub_value2 FROM summary_out"
        for o, label, unit, v, sl, s1, s2 in rows
    ]
    return " UNION ALL ".join(parts)


def _insights() -> str:
    def row(o: int, kind: str, title: str, headline: str, value: str, extra: str,
            src: str, note: str = "CAST(NULL AS VARCHAR)") -> str:
        return (f"SELECT {o} AS ord, {kind} AS kind, '{title}' AS title, "
                f"CAST({headline} AS VARCHAR) AS headline, CAST({value} AS DOUBLE) AS value, "
                f"CAST({extra} AS DOUBLE) AS extra, {note} AS note FROM {src}")
    return " UNION ALL ".join([
        row(1, "'positive'", "Top On-Time Carrier", "AIRLINE", "arrival_delay", "flights", "best"),
        row(2, "'warning'", "Highest Carrier Delay", "AIRLINE", "arrival_delay", "flights", "worst"),
        row(3, "'info'", "Busiest Origin Airport", "coalesce(ORIGIN_AIRPORT, '—')",
            "arrival_delay", "flights", "busiest"),
        row(4, "'highlight'", "Peak Delay Season", "month_name", "avg_arrival_delay",
            "delta_pct", "peak"),
        row(5, "'info'", "Dominant Delay Driver", "cause", R("share * 100", 4), "value", "dominant"),
        row(6, "grade", "Network Cancellation Rate", "NULL", "rate_pct", "cancelled_rate",
            "health", GRADE_NOTE),
    ])


ORACLE: dict[str, str] = {
    "standardise_2015": _q('SELECT * FROM flights WHERE "YEAR" <= 2017'),
    "standardise_2018_2024": _q('SELECT * FROM flights WHERE NOT ("YEAR" <= 2017)'),
    "unified_flights": _q("SELECT * FROM flights"),
    "by_airline": _q("SELECT * FROM airlines_out"),
    "by_airport_top50": _q("SELECT * FROM airports_out"),
    "by_month": _q("SELECT * FROM monthly_out"),
    "summary": _q("SELECT * FROM summary_out"),
    "null_airline_check": _q(
        "SELECT count(*) AS total_rows, count(*) FILTER (WHERE AIRLINE IS NULL) AS null_airline_rows "
        "FROM flights"),
    "source_profile": _q(
        "SELECT '2015' AS source, count(*) AS raw_rows, 17 AS raw_columns FROM fixture "
        "WHERE CAST(yr AS INTEGER) <= 2017 UNION ALL "
        "SELECT '2018_2024' AS source, count(*) AS raw_rows, 17 AS raw_columns FROM fixture "
        "WHERE (CAST(yr AS INTEGER) <= 2017) IS NOT TRUE"),
    "run_totals": _q(
        "SELECT (SELECT total_flights FROM summary_out) AS total_rows, "
        "(SELECT count(*) FROM airlines_out) AS airlines, "
        "(SELECT count(*) FROM airports_out) AS airports, "
        "(SELECT count(*) FROM monthly_out) AS periods"),
    "airport_traffic_top15": _q(
        f"SELECT ORIGIN_AIRPORT, CAST(coalesce(flights, 0) AS BIGINT) AS flights, "
        f"{NUM('arrival_delay')} AS arrival_delay, {NUM('cancelled')} AS cancelled, "
        f"{R(NUM('cancelled') + ' * 100', 2)} AS cancelled_pct "
        f"FROM airports_s {_TOP_AIRPORTS} LIMIT 15"),
    "airport_delay_matrix": _q(
        f"SELECT ORIGIN_AIRPORT, {_delay_cols([c for _, c in _MATRIX])} "
        f"FROM airports_s {_TOP_AIRPORTS} LIMIT 10"),
    "airport_delay_matrix_long": _q(
        " UNION ALL ".join(f"SELECT ORIGIN_AIRPORT, '{label}' AS measure, {c} AS minutes FROM m"
                           for label, c in _MATRIX),
        f"m AS (SELECT ORIGIN_AIRPORT, {_delay_cols([c for _, c in _MATRIX])} "
        f"FROM airports_s {_TOP_AIRPORTS} LIMIT 10)"),
    "delay_breakdown_top12": _q(
        f"SELECT AIRLINE, CAST(flights AS BIGINT) AS flights, {_delay_cols(_BREAKDOWN)}, "
        f"{' + '.join(NUM(c) for c in _BREAKDOWN)} AS total_delay "
        f"FROM airlines_s {_TOP_AIRLINES} LIMIT 12"),
    "cancellation_top15": _q(
        "SELECT AIRLINE, flights, cancel_pct, CASE WHEN max(cancel_pct) OVER () > 0 "
        "THEN cancel_pct / max(cancel_pct) OVER () END AS intensity FROM r",
        f"r AS (SELECT AIRLINE, CAST({NUM('flights')} AS BIGINT) AS flights, "
        f"{NUM('cancelled')} * 100 AS cancel_pct FROM airlines_s "
        f"ORDER BY cancel_pct DESC, AIRLINE ASC NULLS LAST LIMIT 15)"),
    "airline_table_sorted": _q(
        f"SELECT *, CAST(row_number() OVER ({_TOP_AIRLINES}) AS INTEGER) AS position "
        f"FROM airlines_s"),
    "airline_table_by_arrival_asc": _q(
        f"SELECT *, CAST(row_number() OVER (ORDER BY {NUM('arrival_delay')} ASC, "
        f"AIRLINE ASC NULLS LAST) AS INTEGER) AS position FROM airlines_s"),
    "airline_severity": _q(
        f"SELECT AIRLINE, {', '.join(_severity(c) for c in _SEVERITY)} FROM airlines_s"),
    "monthly_trends": _q(
        f"SELECT {_month_label()} AS label, \"YEAR\", \"MONTH\", "
        f"{_delay_cols(['arrival_delay', 'departure_delay', 'carrier_delay', 'weather_delay'])}, "
        f"CAST(coalesce(flights, 0) AS BIGINT) AS flights FROM monthly_s"),
    "delay_scatter": _q(
        f"SELECT ORIGIN_AIRPORT, {NUM('departure_delay')} AS departure_delay, "
        f"{NUM('arrival_delay')} AS arrival_delay, CAST({NUM('flights')} AS BIGINT) AS flights, "
        f"{NUM('cancelled')} AS cancelled, "
        f"{NUM('arrival_delay')} > {NUM('departure_delay')} AS above_diagonal FROM airports_s"),
    "seasonality": _q("SELECT * FROM season"),
    "peak_month": _q("SELECT * FROM peak"),
    "cause_shares": _q(
        "SELECT ord, cause, value, CASE WHEN total > 0 THEN value / total END AS share "
        "FROM causes, cause_total WHERE value > 0"),
    "best_carrier": _q("SELECT * FROM best"),
    "worst_carrier": _q("SELECT * FROM worst"),
    "busiest_airport": _q("SELECT * FROM busiest"),
    "dominant_cause": _q("SELECT * FROM dominant"),
    "cancellation_grade": _q(f"SELECT *, {GRADE_NOTE} AS note FROM health"),
    "kpi_rows": _q(_kpi()),
    "insights": _q(_insights()),
    "rollup_by_airline": _q("SELECT * FROM airlines_out"),
    "rollup_by_airport_top50": _q("SELECT * FROM airports_out"),
    "rollup_by_month": _q("SELECT * FROM monthly_out"),
    "rollup_summary": _q("SELECT * FROM summary_out"),
}


def oracle_sql() -> dict[str, str]:
    from skyroll.oracle_input import SQL   # it builds on this module

    return {**ORACLE, **SQL}


# ----------------------------------------------------------- step 5 - 7

def D(x: str) -> str:
    return f"CAST(round({x}, 6) AS DECIMAL(38,6))"


_AIRLINE_COLS = ["carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_delay",
                 "arrival_delay", "departure_delay", "cancelled", "diverted"]
_AIRPORT_COLS = ["arrival_delay", "departure_delay", "carrier_delay", "weather_delay",
                 "nas_delay", "cancelled", "diverted"]
_MONTH_COLS = ["arrival_delay", "departure_delay", "carrier_delay", "weather_delay", "cancelled"]
_SUMMARY_COLS = ["avg_arrival_delay", "avg_departure_delay", "avg_carrier_delay",
                 "avg_weather_delay", "avg_nas_delay", "avg_security_delay", "avg_late_delay",
                 "cancelled_rate", "diverted_rate", "avg_distance"]


def _keyed_sql(src: str, key: str, keys: str, cols: list[str], where: str) -> str:
    decs = ", ".join(f"{D(c)} AS {c}" for c in cols)
    return f"SELECT {key} AS item_key, {keys}, {decs} FROM {src} WHERE {where}"


_KEYED_AIRLINES = _keyed_sql("airlines_out", "AIRLINE", "AIRLINE, flights", _AIRLINE_COLS,
                             "AIRLINE IS NOT NULL")
_MONTH_KEY = """printf('%04d-%02d', "YEAR", "MONTH")"""


def _airport_top(where: str) -> str:
    return (f"SELECT ORIGIN_AIRPORT, count(*) AS flights, "
            f"{R('avg(ARRIVAL_DELAY)', 2)} AS arrival_delay, "
            f"{R('avg(DEPARTURE_DELAY)', 2)} AS departure_delay, "
            f"{R('avg(CARRIER_DELAY)', 2)} AS carrier_delay, "
            f"{R('avg(WEATHER_DELAY)', 2)} AS weather_delay, {R('avg(NAS_DELAY)', 2)} AS nas_delay, "
            f"{R('avg(CANCELLED)', 4)} AS cancelled, {R('avg(DIVERTED)', 4)} AS diverted "
            f"FROM flights WHERE {where} GROUP BY ORIGIN_AIRPORT "
            f"ORDER BY flights DESC, ORIGIN_AIRPORT ASC NULLS LAST LIMIT 50")


_UPSERT = _q(
    "SELECT * FROM old_items WHERE item_key NOT IN (SELECT item_key FROM new_items) "
    "UNION ALL SELECT * FROM new_items",
    f"early_top AS ({_airport_top('\"YEAR\" <= 2017')}),\n"
    f"old_items AS ({_keyed_sql('early_top', 'ORIGIN_AIRPORT', 'ORIGIN_AIRPORT, flights', _AIRPORT_COLS, 'ORIGIN_AIRPORT IS NOT NULL')}),\n"
    f"new_items AS ({_keyed_sql('airports_out', 'ORIGIN_AIRPORT', 'ORIGIN_AIRPORT, flights', _AIRPORT_COLS, 'ORIGIN_AIRPORT IS NOT NULL')})")

_UPSERT_NEW_COLUMN = _q(
    "SELECT * REPLACE (CAST(NULL AS DECIMAL(38,6)) AS diverted) FROM old_items "
    "WHERE item_key NOT IN (SELECT item_key FROM new_items) "
    "UNION ALL SELECT * FROM new_items",
    f"early_top AS ({_airport_top('\"YEAR\" <= 2017')}),\n"
    f"old_items AS ({_keyed_sql('early_top', 'ORIGIN_AIRPORT', 'ORIGIN_AIRPORT, flights', _AIRPORT_COLS, 'ORIGIN_AIRPORT IS NOT NULL')}),\n"
    f"new_items AS ({_keyed_sql('airports_out', 'ORIGIN_AIRPORT', 'ORIGIN_AIRPORT, flights', _AIRPORT_COLS, 'ORIGIN_AIRPORT IS NOT NULL')})")

_OUTPUT_COUNTS = """(SELECT 'airlines' AS output, count(*) AS rows FROM airlines_out
  UNION ALL SELECT 'airports' AS output, count(*) AS rows FROM airports_out
  UNION ALL SELECT 'monthly' AS output, count(*) AS rows FROM monthly_out
  UNION ALL SELECT 'delaySummary' AS output, count(*) AS rows FROM summary_out)"""

_REPLAY = """SELECT 'airlines' AS output, 'flight_airlines' AS store_table, count(*) AS written
  FROM airlines_out WHERE AIRLINE IS NOT NULL
  UNION ALL SELECT 'airports', 'flight_airports', count(*) FROM airports_out
  WHERE ORIGIN_AIRPORT IS NOT NULL
  UNION ALL SELECT 'monthly', 'flight_monthly', count(*) FROM monthly_out
  WHERE "YEAR" IS NOT NULL AND "MONTH" IS NOT NULL
  UNION ALL SELECT 'delaySummary', 'flight_summary', count(*) FROM summary_out"""

HOLIDAYS = """
hp AS (SELECT CAST(year(o_orderdate) + 20 AS INTEGER) AS "year",
  CAST(o_orderkey AS BIGINT) AS position,
  printf('%04d-%02d-%02d', year(o_orderdate) + 20, month(o_orderdate), day(o_orderdate)) AS date,
  CASE WHEN o_custkey % 10 <> 0 THEN concat('Day ', CAST(o_custkey % 50 AS VARCHAR)) END AS name,
  CASE WHEN o_custkey % 15 <> 0 THEN o_orderpriority END AS localName,
  CASE WHEN o_custkey % 11 <> 0 THEN o_orderstatus = 'F' END AS fixed,
  CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice > 150000 END AS "global",
  CASE WHEN o_custkey % 3 <> 0 THEN ['Public', o_orderpriority] END AS types
  FROM orders),
hn AS (SELECT date, coalesce(name, '') AS name, coalesce(localName, '') AS localName, "year",
  CAST(split_part(date, '-', 2) AS INTEGER) AS "month",
  CAST(split_part(date, '-', 3) AS INTEGER) AS "day",
  coalesce(fixed, false) AS fixed, coalesce("global", false) AS "global",
  coalesce(types, CAST([] AS VARCHAR[])) AS types, position FROM hp),
hs AS (SELECT date, name, localName, "year", "month", "day", fixed, "global", types FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY "year" DESC, position DESC) AS rn
  FROM hn) WHERE rn = 1)"""


def _h(body: str) -> str:
    return f"WITH {HOLIDAYS}\n{body}"


_MEASURES = [("ARRIVAL_DELAY", 2), ("DEPARTURE_DELAY", 2), ("CARRIER_DELAY", 2),
             ("WEATHER_DELAY", 2), ("NAS_DELAY", 2), ("SECURITY_DELAY", 2),
             ("LATE_AIRCRAFT_DELAY", 2), ("CANCELLED", 4), ("DIVERTED", 4), ("DISTANCE", 2)]


def _grain(name: str, keys: dict[str, str], group: str) -> str:
    key_sql = ", ".join(f"{expr} AS {col}" for col, expr in keys.items())
    means = ", ".join(f"{R(f'avg({m})', d)} AS {m}" for m, d in _MEASURES)
    tail = f" GROUP BY {group}" if group else ""
    return (f"SELECT '{name}' AS grain, {key_sql}, count(*) AS n, {means}, "
            f"min(\"YEAR\") AS min_year, max(\"YEAR\") AS max_year FROM flights{tail}")


_NULLS = {"AIRLINE": "CAST(NULL AS VARCHAR)", "ORIGIN_AIRPORT": "CAST(NULL AS VARCHAR)",
          '"YEAR"': "CAST(NULL AS INTEGER)", '"MONTH"': "CAST(NULL AS INTEGER)"}


def _keys(**grouped: str) -> dict[str, str]:
    out = dict(_NULLS)
    for col in grouped.values():
        out[col] = col
    return out


_GRAINS = " UNION ALL ".join([
    _grain("airline", _keys(a="AIRLINE"), "AIRLINE"),
    _grain("airport", _keys(a="ORIGIN_AIRPORT"), "ORIGIN_AIRPORT"),
    _grain("month", _keys(a='"YEAR"', b='"MONTH"'), '"YEAR", "MONTH"'),
    _grain("all", _keys(), ""),
])

ORACLE.update({
    "keyed_items_airlines": _q(_KEYED_AIRLINES),
    "keyed_items_airports": _q(_keyed_sql("airports_out", "ORIGIN_AIRPORT",
                                          "ORIGIN_AIRPORT, flights", _AIRPORT_COLS,
                                          "ORIGIN_AIRPORT IS NOT NULL")),
    "keyed_items_monthly": _q(_keyed_sql("monthly_out", _MONTH_KEY, '"YEAR", "MONTH", flights',
                                         _MONTH_COLS, '"YEAR" IS NOT NULL AND "MONTH" IS NOT NULL')),
    "keyed_items_summary": _q(_keyed_sql("summary_out", "'global'",
                                         "total_flights, min_year, max_year", _SUMMARY_COLS,
                                         "true")),
    "keyed_upsert": _UPSERT,
    "keyed_store_roundtrip": _UPSERT,
    "keyed_upsert_new_column": _UPSERT_NEW_COLUMN,
    "json_roundtrip": _q("SELECT * FROM airlines_out"),
    "csv_roundtrip": _q("SELECT * FROM airlines_out"),
    "served_read": _q(f"SELECT *, 'store' AS data_source FROM ({_KEYED_AIRLINES})"),
    "served_read_fallback": _q("SELECT *, 'json' AS data_source FROM airlines_out"),
    "readiness": _q(f"SELECT output, rows, rows > 0 AS ready, "
                    f"bool_and(rows > 0) OVER () AS all_ready FROM {_OUTPUT_COUNTS}"),
    "replay_load": _q(_REPLAY),
    "holiday_records": _h("SELECT * EXCLUDE (position) FROM hn"),
    "holidays_normalised": _h("SELECT * FROM hs"),
    "holidays_by_date": _h("SELECT * FROM hs"),
    "holidays_archive_roundtrip": _h("SELECT * FROM hs"),
    "all_grains": _q(_GRAINS),
    "grains_by_airline": _q("SELECT * FROM airlines_out"),
    "grains_by_airport_top50": _q("SELECT * FROM airports_out"),
    "grains_by_month": _q("SELECT * FROM monthly_out"),
    "grains_summary": _q("SELECT * FROM summary_out"),
    "run_source_profile": ORACLE["source_profile"],
    "csv_sources_profile": ORACLE["source_profile"].replace("17 AS raw_columns", "19 AS raw_columns"),
    "csv_sources_by_airline": ORACLE["by_airline"],
    "streaming_csv_by_airline": ORACLE["by_airline"],
    "streaming_by_airline": _q("SELECT * FROM airlines_out"),
    "streaming_by_month": _q("SELECT * FROM monthly_out"),
    "streaming_summary": _q("SELECT * FROM summary_out"),
    "streaming_keyed_airlines": _q(_KEYED_AIRLINES),
    "run_null_airline": ORACLE["null_airline_check"],
})
