"""The four served datasets, as the dashboard reads them after a run.

A fresh run stores each aggregate in the keyed store, which skips rows with
a NULL key; the served tables are therefore the aggregates minus NULL-key
rows. All four come from one grouping-sets aggregate over the fact
(``grain_table``). That table is materialised once with a reliable
checkpoint: otherwise Catalyst pushes each consumer's grain filter and
column pruning below the aggregate, every branch becomes a different plan,
and a query that uses several served datasets would rebuild the fact once
per branch. The grain table holds one row per carrier, airport, month and
one global row, so its size is bounded whatever the fact size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyroll.session import checkpointed

from skyroll.operators.aggregates import (
    airline_from_grains, airline_from_rollup, airport_top_from_grains, airport_top_from_rollup,
    by_airline, by_airport_top, by_month, grain_table, month_from_grains, month_from_rollup, summary, summary_from_grains, summary_from_rollup,
)


@dataclass
class Served:
    airlines: DataFrame
    airports: DataFrame
    monthly: DataFrame
    summary: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {"airlines": self.airlines, "airports": self.airports,
                "monthly": self.monthly, "delaySummary": self.summary}


@dataclass
class Outputs:
    """The four aggregates exactly as a run writes them (NULL keys kept)."""

    airlines: DataFrame
    airports: DataFrame
    monthly: DataFrame
    summary: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {"airlines": self.airlines, "airports": self.airports,
                "monthly": self.monthly, "delaySummary": self.summary}


def outputs_from_rollup(rollup: DataFrame) -> Outputs:
    return Outputs(
        airlines=airline_from_rollup(rollup),
        airports=airport_top_from_rollup(rollup),
        monthly=month_from_rollup(rollup),
        summary=summary_from_rollup(rollup),
    )


def outputs_from_grains(table: DataFrame) -> Outputs:
    return Outputs(
        airlines=airline_from_grains(table),
        airports=airport_top_from_grains(table),
        monthly=month_from_grains(table),
        summary=summary_from_grains(table),
    )


def served_from_outputs(out: Outputs) -> Served:
    return Served(
        airlines=out.airlines.filter(F.col("AIRLINE").isNotNull()),
        airports=out.airports.filter(F.col("ORIGIN_AIRPORT").isNotNull()),
        monthly=out.monthly.filter(F.col("YEAR").isNotNull() & F.col("MONTH").isNotNull()),
        summary=out.summary,
    )


# Each output by its own aggregate, for queries that need just one of them.
DIRECT = {"airlines": by_airline, "airports": by_airport_top, "monthly": by_month,
          "delaySummary": summary}
NULL_KEYS = {"airlines": ["AIRLINE"], "airports": ["ORIGIN_AIRPORT"],
             "monthly": ["YEAR", "MONTH"], "delaySummary": []}


def served_output(flights: DataFrame, name: str) -> DataFrame:
    """One served dataset, lazily and without the other three."""
    return DIRECT[name](flights).dropna(subset=NULL_KEYS[name]) if NULL_KEYS[name] \
        else DIRECT[name](flights)


def served_from_flights(flights: DataFrame, materialise: bool = True) -> Served:
    table = grain_table(flights)
    if materialise:
        table = checkpointed(table)
    return served_from_outputs(outputs_from_grains(table))
