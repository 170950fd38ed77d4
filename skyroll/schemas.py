"""Source layouts, the canonical fact schema and the aggregate column sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These names must equal the raw file headers and the published
# output columns, so they are stated exactly as the data uses them.
# ---------------------------------------------------------------------------

# Canonical column <- (source header, type), per raw layout.
LAYOUT_2015 = [
    ("YEAR", "YEAR", "int"),
    ("MONTH", "MONTH", "int"),
    ("DAY", "DAY", "int"),
    ("DAY_OF_WEEK", "DAY_OF_WEEK", "int"),
    ("AIRLINE", "AIRLINE", "string"),
    ("ORIGIN_AIRPORT", "ORIGIN_AIRPORT", "string"),
    ("DESTINATION_AIRPORT", "DESTINATION_AIRPORT", "string"),
    ("ARRIVAL_DELAY", "ARRIVAL_DELAY", "double"),
    ("DEPARTURE_DELAY", "DEPARTURE_DELAY", "double"),
    ("CARRIER_DELAY", "AIRLINE_DELAY", "double"),
    ("WEATHER_DELAY", "WEATHER_DELAY", "double"),
    ("NAS_DELAY", "AIR_SYSTEM_DELAY", "double"),
    ("SECURITY_DELAY", "SECURITY_DELAY", "double"),
    ("LATE_AIRCRAFT_DELAY", "LATE_AIRCRAFT_DELAY", "double"),
    ("CANCELLED", "CANCELLED", "double"),
    ("DIVERTED", "DIVERTED", "double"),
    ("DISTANCE", "DISTANCE", "double"),
]

LAYOUT_2018_2024 = [
    ("YEAR", "Year", "int"),
    ("MONTH", "Month", "int"),
    ("DAY", "DayofMonth", "int"),
    ("DAY_OF_WEEK", "DayOfWeek", "int"),
    ("AIRLINE", "IATA_Code_Operating_Airline", "string"),
    ("ORIGIN_AIRPORT", "Origin", "string"),
    ("DESTINATION_AIRPORT", "Dest", "string"),
    ("ARRIVAL_DELAY", "ArrDelay", "double"),
    ("DEPARTURE_DELAY", "DepDelay", "double"),
    ("CARRIER_DELAY", "CarrierDelay", "double"),
    ("WEATHER_DELAY", "WeatherDelay", "double"),
    ("NAS_DELAY", "NASDelay", "double"),
    ("SECURITY_DELAY", "SecurityDelay", "double"),
    ("LATE_AIRCRAFT_DELAY", "LateAircraftDelay", "double"),
    ("CANCELLED", "Cancelled", "double"),
    ("DIVERTED", "Diverted", "double"),
    ("DISTANCE", "Distance", "double"),
]

# Fact measure -> output column name in the aggregates.
MEASURE_ALIAS = {
    "CARRIER_DELAY": "carrier_delay",
    "WEATHER_DELAY": "weather_delay",
    "NAS_DELAY": "nas_delay",
    "SECURITY_DELAY": "security_delay",
    "LATE_AIRCRAFT_DELAY": "late_delay",
    "ARRIVAL_DELAY": "arrival_delay",
    "DEPARTURE_DELAY": "departure_delay",
    "CANCELLED": "cancelled",
    "DIVERTED": "diverted",
}

# Measures per aggregate, in output column order. Delays are rounded to
# 2 decimals, cancellation / diversion rates to 4.
AIRLINE_DELAYS = ["CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY",
                  "LATE_AIRCRAFT_DELAY", "ARRIVAL_DELAY", "DEPARTURE_DELAY"]
AIRPORT_DELAYS = ["ARRIVAL_DELAY", "DEPARTURE_DELAY", "CARRIER_DELAY",
                  "WEATHER_DELAY", "NAS_DELAY"]
MONTHLY_DELAYS = ["ARRIVAL_DELAY", "DEPARTURE_DELAY", "CARRIER_DELAY", "WEATHER_DELAY"]
RATES = ["CANCELLED", "DIVERTED"]
DELAY_DIGITS = 2
RATE_DIGITS = 4
AIRPORT_TOP_N = 50

# Summary: output column <- (fact column, digits).
SUMMARY_MEANS = [
    ("avg_arrival_delay", "ARRIVAL_DELAY", 2),
    ("avg_departure_delay", "DEPARTURE_DELAY", 2),
    ("avg_carrier_delay", "CARRIER_DELAY", 2),
    ("avg_weather_delay", "WEATHER_DELAY", 2),
    ("avg_nas_delay", "NAS_DELAY", 2),
    ("avg_security_delay", "SECURITY_DELAY", 2),
    ("avg_late_delay", "LATE_AIRCRAFT_DELAY", 2),
    ("cancelled_rate", "CANCELLED", 4),
    ("diverted_rate", "DIVERTED", 4),
    ("avg_distance", "DISTANCE", 2),
]

# Delay causes shown as shares of the summary, in listed order.
CAUSES = [
    ("Carrier", "avg_carrier_delay"),
    ("Weather", "avg_weather_delay"),
    ("NAS", "avg_nas_delay"),
    ("Security", "avg_security_delay"),
    ("Late Aircraft", "avg_late_delay"),
]

MONTH_NAMES = ["January", "February", "March", "April", "May", "June",
               "July", "August", "September", "October", "November", "December"]
MONTH_ABBREV = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Keyed store: output name -> (store table, key rule).
KEYED_OUTPUTS = {
    "airlines": ("flight_airlines", "AIRLINE"),
    "airports": ("flight_airports", "ORIGIN_AIRPORT"),
    "monthly": ("flight_monthly", "YEAR-MONTH"),
    "delaySummary": ("flight_summary", "global"),
}
OUTPUT_NAMES = ["airlines", "airports", "monthly", "delaySummary"]

# ---------------------------------------------------------------------------
# Derived schemas
# ---------------------------------------------------------------------------

_SPARK_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


@dataclass(frozen=True)
class SourceSpec:
    """One raw layout: a label, where its files live, and its column mapping."""

    label: str
    path: str | None
    columns: tuple[tuple[str, str, str], ...]

    @property
    def source_columns(self) -> list[str]:
        return [src for _, src, _ in self.columns]


def source_specs(paths: dict[str, str] | None = None) -> list[SourceSpec]:
    paths = paths or {}
    return [
        SourceSpec("2015", paths.get("2015"), tuple(LAYOUT_2015)),
        SourceSpec("2018_2024", paths.get("2018_2024"), tuple(LAYOUT_2018_2024)),
    ]


FLIGHTS_SCHEMA = T.StructType([
    T.StructField(canon, _SPARK_TYPES[kind], True) for canon, _, kind in LAYOUT_2015
])


def raw_schema(spec: SourceSpec) -> T.StructType:
    """All-string schema of a raw layout (headers are read, never inferred)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in spec.source_columns])

