"""Raw layout -> canonical fact table (PRJ1, PRJ2, SET1).

``standardise`` is a single projection: each canonical column is the typed
cast of one source column, unmapped source columns are dropped (so the
parquet/CSV scan only reads the 17 mapped columns). A mapped column that is
missing is an analysis error, as in any ``select``.

Source columns are matched by exact name first. When a raw header holds
the same name in two cases (``airline`` and ``AIRLINE``) a name lookup
would be ambiguous on a case-insensitive session, so columns are renamed by
position (``toDF``) before the projection; that rename is free (no data is
touched).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from skyroll.functions.casts import typed_sql
from skyroll.schemas import SourceSpec, source_specs


class MissingColumnError(ValueError):
    pass


def _resolve(columns: list[str], wanted: str) -> int:
    exact = [i for i, c in enumerate(columns) if c == wanted]
    if exact:
        return exact[0]
    folded = [i for i, c in enumerate(columns) if c.lower() == wanted.lower()]
    if len(folded) == 1:
        return folded[0]
    if not folded:
        raise MissingColumnError(f"mapped source column {wanted!r} not found in {columns}")
    raise MissingColumnError(f"source column {wanted!r} is ambiguous in {columns}")


def standardise(raw: DataFrame, spec: SourceSpec,
                carried: list[str] | None = None) -> DataFrame:
    """``carried`` names columns of ``raw`` that come along unchanged."""
    cols = raw.columns
    positions = [_resolve(cols, src) for _, src, _ in spec.columns]
    if len({c.lower() for c in cols}) == len(cols):
        named = raw
        refs = [cols[i] for i in positions]
    else:
        named = raw.toDF(*[f"_c{i}" for i in range(len(cols))])
        refs = [f"_c{i}" for i in positions]
    return named.selectExpr(*[f"{typed_sql(ref, kind)} AS `{canon}`"
                              for ref, (canon, _, kind) in zip(refs, spec.columns)],
                            *[f"`{named.columns[cols.index(c)]}` AS `{c}`" for c in carried or []])


def unify(parts: list[DataFrame]) -> DataFrame:
    """Union all of standardised layouts, matched by column name (SET1)."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def flights_from_sources(raw_by_label: dict[str, DataFrame],
                         specs: list[SourceSpec] | None = None) -> DataFrame:
    """Standardise every labelled raw source and union them into the fact."""
    specs = specs or source_specs()
    by_label = {s.label: s for s in specs}
    parts = [standardise(df, by_label[label]) for label, df in raw_by_label.items()]
    return unify(parts)
