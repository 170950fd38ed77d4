"""Seasonality, cause shares, KPI rows and the insight set
(AGG5-AGG7, TOP8, TOP9, FLT4, FLT5, PRJ12, PRJ13, CMP1).

All inputs are served aggregates: at most one row per month, one summary
row, one row per carrier / top airport. Means of rounded monthly values are
summed in integer hundredths, so they are exact whatever order the rows
arrive in; derived ratios that combine several means are rounded to 4
places for the same reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyroll.functions.labels import (
    cancellation_grade, cancellation_note, month_label, month_name,
)
from skyroll.functions.measures import num, pct
from skyroll.operators.rankings import best_carrier, busiest_airport, worst_carrier
from skyroll.schemas import CAUSES, SUMMARY_MEANS

DERIVED_DIGITS = 4
# Fact column behind each of ``CAUSES``, in the same order.
CAUSE_COLUMNS = [{alias: source for alias, source, _ in SUMMARY_MEANS}[a] for _, a in CAUSES]

# Insight kinds and titles, in display order.
INSIGHT_TITLES = [
    ("positive", "Top On-Time Carrier"),
    ("warning", "Highest Carrier Delay"),
    ("info", "Busiest Origin Airport"),
    ("highlight", "Peak Delay Season"),
    ("info", "Dominant Delay Driver"),
    (None, "Network Cancellation Rate"),   # kind is the cancellation grade
]

# KPI cards (label, unit, value column, sub label, sub columns).
KPI_CARDS = [
    ("Total Flights", None, "total_flights", "years", ("min_year", "max_year")),
    ("Avg Arrival Delay", "min", "avg_arrival_delay", "vs dep", ("avg_departure_delay",)),
    ("Avg Departure Delay", "min", "avg_departure_delay", "carrier", ("avg_carrier_delay",)),
    ("Cancellation Rate", "%", "cancelled_rate", "diversion", ("diverted_rate",)),
    ("Avg Weather Delay", "min", "avg_weather_delay", "NAS", ("avg_nas_delay",)),
    ("Avg Flight Distance", "mi", "avg_distance", "security", ("avg_security_delay",)),
]
PERCENT_COLUMNS = {"cancelled_rate", "diverted_rate"}


TREND_MEASURES = ["arrival_delay", "departure_delay", "carrier_delay", "weather_delay"]


def monthly_trends(monthly: DataFrame) -> DataFrame:
    """Month-by-month series in time order with a 'Jan 2015' label (SRT2, PRJ10)."""
    return (monthly.orderBy("YEAR", "MONTH")
            .select(month_label(F.col("YEAR"), F.col("MONTH")).alias("label"), "YEAR", "MONTH",
                    *[num(c).alias(c) for c in TREND_MEASURES],
                    F.coalesce(F.col("flights"), F.lit(0)).cast("bigint").alias("flights")))


def seasonality(monthly: DataFrame) -> DataFrame:
    """Unweighted mean of the monthly arrival-delay means per calendar month
    (AGG5). Months outside 1..12 are ignored (FLT4)."""
    month = num("MONTH")
    cents = F.round(num("arrival_delay") * 100).cast("bigint")
    return (monthly.filter((month >= 1) & (month <= 12))
            .groupBy(month.cast("int").alias("MONTH"))
            .agg(F.sum(cents).alias("_cents"), F.count(F.lit(1)).alias("periods"))
            .select("MONTH", month_name(F.col("MONTH")).alias("month_name"),
                    (F.col("_cents") / (F.col("periods") * F.lit(100.0))).alias("avg_arrival_delay"),
                    "periods"))


def peak_month(monthly: DataFrame) -> DataFrame:
    """Calendar month with the highest seasonal mean (TOP8; ties -> lowest
    month), the mean over months and the peak's % delta from it (AGG6; 0
    when the mean is 0). One global aggregate over at most 12 rows."""
    season = seasonality(monthly)
    rank_key = F.struct(F.col("avg_arrival_delay"), (-F.col("MONTH")).alias("m"))
    agg = season.agg(
        F.max_by(F.struct("MONTH", "month_name", "avg_arrival_delay"), rank_key).alias("peak"),
        F.avg("avg_arrival_delay").alias("_network"),
        F.count(F.lit(1)).alias("_months"),
    ).filter(F.col("_months") > 0)
    net = F.col("_network")
    delta = F.when(net != 0, (F.col("peak.avg_arrival_delay") - net) / net * 100).otherwise(0.0)
    return agg.select(
        F.col("peak.MONTH").alias("MONTH"),
        F.col("peak.month_name").alias("month_name"),
        F.col("peak.avg_arrival_delay").alias("avg_arrival_delay"),
        F.round(net, DERIVED_DIGITS).alias("network_avg_delay"),
        F.round(delta, DERIVED_DIGITS).alias("delta_pct"),
    )


def _cause_rows(summary: DataFrame) -> DataFrame:
    values = [num(col) for _, col in CAUSES]
    total = reduce(lambda a, b: a + b, values)
    entries = []
    for i, ((label, _), v) in enumerate(zip(CAUSES, values), start=1):
        entries += [F.lit(i), F.lit(label), v]
    stacked = F.inline(F.array(*[
        F.struct(entries[k].alias("ord"), entries[k + 1].alias("cause"),
                 entries[k + 2].alias("value"))
        for k in range(0, len(entries), 3)]))
    return summary.select(stacked, total.alias("total"))


def cause_shares(summary: DataFrame) -> DataFrame:
    """Mean minutes per delay cause and its share of the five (AGG7);
    causes with no minutes are left out (FLT5)."""
    rows = _cause_rows(summary)
    return (rows.filter(F.col("value") > 0)
            .select("ord", "cause", "value",
                    F.when(F.col("total") > 0, F.col("value") / F.col("total")).alias("share")))


def dominant_cause(summary: DataFrame) -> DataFrame:
    """Largest cause (TOP9; ties -> listed order), only when any cause has minutes."""
    rows = _cause_rows(summary).filter(F.col("total") > 0)
    return (rows.orderBy(F.col("value").desc(), F.col("ord").asc()).limit(1)
            .select("cause", "value", (F.col("value") / F.col("total")).alias("share")))


def cancellation_health(summary: DataFrame) -> DataFrame:
    """Network cancellation percent and its grade (PRJ12)."""
    rate = num("cancelled_rate") * 100
    return (summary.filter(F.col("cancelled_rate").isNotNull())
            .select("cancelled_rate", pct(num("cancelled_rate")).alias("rate_pct"),
                    cancellation_grade(rate).alias("grade"))
            .withColumn("note", cancellation_note(F.col("grade"))))


def kpi_rows(summary: DataFrame) -> DataFrame:
    """The six headline measures with their sub-measures, one row each (PRJ13)."""
    def value(col: str) -> Column:
        c = F.col(col).cast("double")
        return pct(c) if col in PERCENT_COLUMNS else c

    cards = []
    for i, (label, unit, col, sub_label, subs) in enumerate(KPI_CARDS, start=1):
        sub_values = [value(s) for s in subs] + [F.lit(None).cast("double")] * (2 - len(subs))
        cards.append(F.struct(
            F.lit(i).alias("ord"), F.lit(label).alias("label"),
            F.lit(unit).cast("string").alias("unit"), value(col).alias("value"),
            F.lit(sub_label).alias("sub_label"),
            sub_values[0].alias("sub_value"), sub_values[1].alias("sub_value2")))
    return summary.select(F.inline(F.array(*cards)))


def _insight(df: DataFrame, ord_: int, headline: Column, value: Column, extra: Column,
             kind: Column | None = None, note: Column | None = None) -> DataFrame:
    default_kind, title = INSIGHT_TITLES[ord_ - 1]
    return df.select(
        F.lit(ord_).alias("ord"),
        (kind if kind is not None else F.lit(default_kind)).alias("kind"),
        F.lit(title).alias("title"),
        headline.cast("string").alias("headline"),
        value.cast("double").alias("value"),
        extra.cast("double").alias("extra"),
        (note if note is not None else F.lit(None).cast("string")).alias("note"),
    )


def insights(airlines: DataFrame, airports: DataFrame, monthly: DataFrame,
             summary: DataFrame, min_flights: int) -> DataFrame:
    """Up to six labelled highlight rows (CMP1); a row whose input is empty
    is simply absent, because each part is a zero-or-one-row DataFrame."""
    best = best_carrier(airlines, min_flights)
    worst = worst_carrier(airlines, min_flights)
    busiest = busiest_airport(airports)
    peak = peak_month(monthly)
    cause = dominant_cause(summary)
    health = cancellation_health(summary)
    parts = [
        _insight(best, 1, F.col("AIRLINE"), F.col("arrival_delay"), F.col("flights")),
        _insight(worst, 2, F.col("AIRLINE"), F.col("arrival_delay"), F.col("flights")),
        _insight(busiest, 3, F.coalesce(F.col("ORIGIN_AIRPORT"), F.lit("—")),
                 F.col("arrival_delay"), F.col("flights")),
        _insight(peak, 4, F.col("month_name"), F.col("avg_arrival_delay"), F.col("delta_pct")),
        _insight(cause, 5, F.col("cause"), F.round(F.col("share") * 100, DERIVED_DIGITS),
                 F.col("value")),
        _insight(health, 6, F.lit(None), F.col("rate_pct"), F.col("cancelled_rate"),
                 kind=F.col("grade"), note=F.col("note")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def insights_from_grains(table: DataFrame, min_flights: int) -> DataFrame:
    """The same insight rows from a grain table in one pass: a single aggregate with
    a filter per part gathers one record for each insight, and ``inline`` turns those
    that exist into rows. Calendar months are twelve (sum, count) pairs of that
    aggregate. Served rows only: groups without a key take no part."""
    grain, arrival, flights = F.col("grain"), num("ARRIVAL_DELAY"), F.col("n")
    carrier = ((grain == "airline") & F.col("AIRLINE").isNotNull()
               & (flights.cast("double") > min_flights))
    airport = (grain == "airport") & F.col("ORIGIN_AIRPORT").isNotNull()
    month = (grain == "month") & F.col("YEAR").isNotNull() & F.col("MONTH").isNotNull()
    cents = F.round(arrival * 100).cast("bigint")

    def first_by(part: Column, key: str, order: Column) -> Column:
        record = F.struct(F.col(key).alias("key"), arrival.alias("value"),
                          flights.cast("bigint").alias("flights"))
        return F.min_by(record, F.when(part, F.struct(order, F.col(key))))

    seen = [F.count_if(month & (F.col("MONTH") == m)) for m in range(1, 13)]
    sums = [F.sum(F.when(month & (F.col("MONTH") == m), cents)) for m in range(1, 13)]
    means = F.array(*[
        F.when(n > 0, F.struct((s / (n * F.lit(100.0))).alias("mean"), F.lit(-m).alias("m")))
        for m, (n, s) in enumerate(zip(seen, sums), start=1)])
    causes = [num(F.max(F.when(grain == "all", F.col(source)))) for source in CAUSE_COLUMNS]
    parts = table.agg(
        first_by(carrier, "AIRLINE", arrival).alias("best"),
        first_by(carrier, "AIRLINE", -arrival).alias("worst"),
        F.count_if(carrier).alias("eligible"),
        first_by(airport, "ORIGIN_AIRPORT", -flights).alias("busiest"),
        F.array_compact(means).alias("season"),
        F.array(*[F.struct(v.alias("value"), F.lit(-i).alias("i"))
                  for i, v in enumerate(causes)]).alias("causes"),
        F.max(F.when(grain == "all", F.col("CANCELLED"))).alias("rate"))
    network = F.aggregate("season", F.lit(0.0), lambda a, x: a + x["mean"]) / F.size("season")
    parts = parts.select(
        "*", F.array_max("season").alias("peak"), F.array_max("causes").alias("cause"),
        F.when(F.size("season") > 0, network).alias("network"),
        F.aggregate("causes", F.lit(0.0), lambda a, x: a + x["value"]).alias("total"))
    names = F.array(*[F.lit(label) for label, _ in CAUSES])
    delta = F.when(F.col("network") != 0,
                   (F.col("peak.mean") - F.col("network")) / F.col("network") * 100).otherwise(0.0)
    grade = cancellation_grade(num("rate") * 100)

    def row(ord_: int, there: Column, headline: Column, value: Column, extra: Column,
            kind: Column | None = None, note: Column | None = None) -> Column:
        default_kind, title = INSIGHT_TITLES[ord_ - 1]
        return F.when(there, F.struct(
            F.lit(ord_).alias("ord"), (F.lit(default_kind) if kind is None else kind).alias("kind"),
            F.lit(title).alias("title"), headline.cast("string").alias("headline"),
            value.cast("double").alias("value"), extra.cast("double").alias("extra"),
            (F.lit(None) if note is None else note).cast("string").alias("note")))

    out = F.array(
        row(1, F.col("best").isNotNull(), F.col("best.key"), F.col("best.value"),
            F.col("best.flights")),
        row(2, F.col("eligible") > 1, F.col("worst.key"), F.col("worst.value"),
            F.col("worst.flights")),
        row(3, F.col("busiest").isNotNull(), F.col("busiest.key"), F.col("busiest.value"),
            F.col("busiest.flights")),
        row(4, F.col("peak").isNotNull(), month_name(-F.col("peak.m")), F.col("peak.mean"),
            F.round(delta, DERIVED_DIGITS)),
        row(5, F.col("total") > 0, F.element_at(names, 1 - F.col("cause.i")),
            F.round(F.col("cause.value") / F.col("total") * 100, DERIVED_DIGITS),
            F.col("cause.value")),
        row(6, F.col("rate").isNotNull(), F.lit(None), pct(num("rate")), F.col("rate"),
            kind=grade, note=cancellation_note(grade)))
    return parts.select(F.inline(F.array_compact(out)))
